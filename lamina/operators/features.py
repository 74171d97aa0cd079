"""What decoded tracks show, as one table of features, and rules as data that are held against it.

Features of a track: cells (length), ones (longest run of ones), gap (longest stretch between marks), headers (blocks that a decoder finds),
duplicates (headers beyond the first of their number), bad (data whose check fails), bad_headers. A rule is a row a term: all (each must hold), any (one
must), none (none may); a term holds where the feature is at least its value. All rules of all machines are evaluated in one join on the
feature and one aggregate, so rules cost rows and no code.

Defined cases: a track without cells has all features 0; a rule without terms never holds; a null value holds no term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as cl
from . import tracks as tr

FEATURES = ("cells", "ones", "gap", "headers", "duplicates", "bad", "bad_headers")


def _marks(encoding: str) -> str:
    """What stands between a track's blocks."""
    digits = lambda hexed: "".join(f"{int(c, 16):04b}" for c in hexed)
    return {"MFM": f"(?:{cl.SYNC}){{3}}", "FM": f"{cl.FM_ADDRESS}|{cl.FM_DATA}", "C64": "1{10,}", "APPLE": f"{digits(cl.APPLE_ADDRESS)}|{digits(cl.APPLE_DATA)}", "AMIGA": f"(?:{cl.SYNC})+"}[encoding]


def features(tracks: DataFrame, encoding: str) -> DataFrame:
    """track and FEATURES of each (track, cells)."""
    longest = lambda parts: F.coalesce(F.array_max(F.transform(parts, lambda x: F.length(x))), F.lit(0)).cast("long")
    cells = F.coalesce("cells", F.lit(""))
    shape = tracks.select("track", F.length(cells).cast("long").alias("cells"), longest(F.regexp_extract_all(cells, F.lit("1+"), F.lit(0))).alias("ones"), longest(F.split(cells, _marks(encoding))).alias("gap"))
    found = tr.DECODERS[encoding](tracks).groupBy("track").agg(
        F.count("*").alias("headers"), (F.count("*") - F.count_distinct("sector")).alias("duplicates"), F.count_if(~F.col("data_ok")).alias("bad"), F.count_if(~F.col("header_ok")).alias("bad_headers"))
    return shape.join(found, "track", "left").na.fill(0)


def hits(table: DataFrame, rules: DataFrame, of: str) -> DataFrame:
    """track, `of`, rule, conf of the rules that hold; rules: `of`, rule, conf, kind (all, any, none), feature, least."""
    long = table.select("track", of, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("long").alias("value")) for f in FEATURES])).alias("x")).select("track", of, "x.*")
    term = long.join(rules, [of, "feature"])
    holds = F.coalesce(F.col("value") >= F.col("least"), F.lit(False))
    kind = lambda k: F.col("kind") == k
    by = term.groupBy("track", of, "rule").agg(
        F.max("conf").alias("conf"), F.bool_and(F.when(kind("all"), holds)).alias("every"), F.bool_or(F.when(kind("any"), holds)).alias("some"), F.bool_or(F.when(kind("none"), holds)).alias("not"))
    return by.where("coalesce(every, true) AND coalesce(some, true) AND NOT coalesce(not, false) AND (every IS NOT NULL OR some IS NOT NULL OR not IS NOT NULL)").select("track", of, "rule", "conf")
