"""Voting, integrity chains and conversion policy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import hard_threshold, sigmoid, soft_threshold
from ..operators import fusion as fus
from ..sources.carriers import SAMPLES, SECTORS, samples, sectors, table
from .base import query

VOTE = f"{SECTORS}, c AS (SELECT track, sector, data, count(*) AS votes FROM sectors GROUP BY 1, 2, 3)"


@query("fuse01_vote", f"""WITH {VOTE} SELECT track, sector, arg_max(data, (votes, -data)) AS data, max(votes) AS votes, CAST(sum(votes) AS BIGINT) AS reads, count(*) AS "values", round(max(votes) / sum(votes), 6) AS agreement FROM c GROUP BY track, sector""")
def vote(spark, sf):
    return fus.vote(sectors(spark, sf), ["track", "sector"], "data")


@query("io13_first_to_lead", f"""WITH {SECTORS}, n AS (SELECT *, row_number() OVER (PARTITION BY track, sector, data ORDER BY read) AS seen FROM sectors) SELECT track, sector, arg_max(data, (seen, -read)) AS data, max(seen) AS votes FROM n GROUP BY track, sector""")
def first_to_lead(spark, sf):
    return fus.first_to_lead(sectors(spark, sf), ["track", "sector"], "read", "data")


@query("fuse03_classify_passes", f"""WITH {SECTORS}, a AS (SELECT track, sector, count(DISTINCT data) AS v, count(DISTINCT CASE WHEN crc_ok THEN data END) AS gv, bool_or(crc_ok) AS good FROM sectors GROUP BY 1, 2)
  SELECT track, sector, CASE WHEN good AND v = 1 THEN 'STABLE_GOOD' WHEN NOT good AND v = 1 THEN 'BAD_CRC' WHEN gv > 1 THEN 'AMBIGUOUS_GOOD' ELSE 'WEAK' END AS class FROM a""")
def classify_passes(spark, sf):
    a = sectors(spark, sf).groupBy("track", "sector").agg(F.count_distinct("data").alias("v"), F.count_distinct(F.when(F.col("crc_ok"), F.col("data"))).alias("gv"), F.bool_or("crc_ok").alias("good"))
    c = F.when(F.col("good") & (F.col("v") == 1), "STABLE_GOOD").when(~F.col("good") & (F.col("v") == 1), "BAD_CRC").when(F.col("gv") > 1, "AMBIGUOUS_GOOD").otherwise("WEAK")
    return a.select("track", "sector", c.alias("class"))


@query("fuse11_best_read", f"WITH {SECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY track, sector ORDER BY crc_ok DESC, read) AS k FROM sectors) SELECT track, sector, read, data, crc_ok FROM r WHERE k = 1")
def best_read(spark, sf):
    return fus.best_read(sectors(spark, sf), ["track", "sector"], "crc_ok", "read").select("track", "sector", "read", "data", "crc_ok")


@query("fuse26_snr_weights", f"""WITH {SAMPLES}, w AS (SELECT label, trace, avg(amp) * avg(amp) / greatest(1.0, var_pop(amp)) AS w FROM samples GROUP BY label, trace) SELECT label, trace, round(w / sum(w) OVER (PARTITION BY label), 6) AS weight FROM w""")
def snr_weights(spark, sf):
    w = samples(spark, sf).groupBy("label", "trace").agg((F.avg("amp") * F.avg("amp") / F.greatest(F.lit(1.0), F.var_pop("amp"))).alias("w"))
    return w.select("label", "trace", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("label")), 6).alias("weight"))


@query("win37_label_stability", """WITH c AS (SELECT user_id AS track, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT track, round(max(n) / sum(n), 6) AS agree, round(1 - sum(n * n) / (sum(n) * sum(n)), 6) AS diversity FROM c GROUP BY track""")
def label_stability(spark, sf):
    return fus.stability(table(spark, sf, "events").withColumnRenamed("user_id", "track"), ["track"], "event_type")


@query("fuse34_provenance_chain", """WITH RECURSIVE e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role || ':' || text AS body FROM conversations),
  c AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, repeat('0', 64) AS h FROM (SELECT DISTINCT conv_id FROM e) UNION ALL SELECT c.conv_id, e.k, sha256(c.h || e.body) FROM c JOIN e ON e.conv_id = c.conv_id AND e.k = c.k + 1)
  SELECT conv_id, max(k) AS entries, arg_max(h, k) AS head FROM c GROUP BY conv_id""")
def provenance_chain(spark, sf):
    log = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("body"))))  # a conversation's turns
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(log.alias("log"))
    head = F.aggregate("log", F.repeat(F.lit("0"), F.lit(64)), lambda h, e: F.sha2(F.concat(h, e["body"]), 256))
    return c.select("conv_id", F.size("log").cast("long").alias("entries"), head.alias("head"))


# The conversion paths and the round-trip matrix.
PATHS = [
    ("SCP", "HFE", "LOSSY"), ("SCP", "G64", "LOSSLESS"), ("KRYOFLUX", "SCP", "LOSSLESS"), ("KRYOFLUX", "HFE", "LOSSY"),
    ("SCP", "D64", "LOSSY"), ("SCP", "ADF", "LOSSY"), ("SCP", "IMG", "LOSSY"), ("KRYOFLUX", "D64", "LOSSY"),
    ("KRYOFLUX", "ADF", "LOSSY"), ("HFE", "SCP", "LOSSLESS"), ("G64", "SCP", "SYNTHETIC"), ("G64", "D64", "LOSSY"),
    ("HFE", "IMG", "LOSSY"), ("HFE", "ADF", "LOSSY"), ("WOZ", "DSK", "LOSSY"), ("NIB", "DSK", "LOSSY"),
    ("G64", "HFE", "LOSSLESS"), ("HFE", "G64", "LOSSY"), ("WOZ", "NIB", "LOSSY"), ("D64", "G64", "SYNTHETIC"),
    ("D64", "HFE", "SYNTHETIC"), ("ADF", "HFE", "SYNTHETIC"), ("IMG", "HFE", "SYNTHETIC"), ("DSK", "WOZ", "SYNTHETIC"),
    ("DSK", "NIB", "SYNTHETIC"), ("D64", "SCP", "SYNTHETIC"), ("ADF", "SCP", "SYNTHETIC"), ("IMG", "SCP", "SYNTHETIC"),
    ("D64", "D64", "LOSSLESS"), ("ADF", "ADF", "LOSSLESS"), ("IMG", "ADF", "LOSSY"), ("ADF", "IMG", "LOSSLESS"),
    ("IMD", "IMG", "LOSSY"), ("IMG", "IMD", "LOSSLESS"), ("IPF", "ADF", "LOSSY"), ("IPF", "IMG", "LOSSY"),
    ("STX", "DSK", "LOSSY"), ("STX", "IMG", "LOSSY"), ("IPF", "SCP", "LOSSY"), ("STX", "SCP", "LOSSY"),
    ("TD0", "IMG", "LOSSY"), ("TD0", "IMD", "LOSSLESS"), ("NBZ", "D64", "LOSSLESS"), ("NBZ", "G64", "LOSSLESS"),
]
MATRIX = [
    ("SCP", "HFE", "LOSSLESS"), ("HFE", "SCP", "LOSSLESS"), ("SCP", "IMG", "LOSSY_DOCUMENTED"), ("SCP", "ADF", "LOSSY_DOCUMENTED"),
    ("SCP", "D64", "LOSSY_DOCUMENTED"), ("SCP", "IMD", "LOSSY_DOCUMENTED"), ("HFE", "IMG", "LOSSY_DOCUMENTED"), ("HFE", "ADF", "LOSSY_DOCUMENTED"),
    ("IMG", "SCP", "IMPOSSIBLE"), ("ADF", "SCP", "IMPOSSIBLE"), ("IMG", "HFE", "IMPOSSIBLE"), ("IPF", "ADF", "LOSSY_DOCUMENTED"),
    ("STX", "ST", "LOSSY_DOCUMENTED"),
]


def _sql_values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join(map(str, rows))


@query("fn01_thresholds", f"WITH {SAMPLES} SELECT trace, idx, round(CASE WHEN amp > 0.1 THEN amp - 0.1 WHEN amp < -0.1 THEN amp + 0.1 ELSE 0 END, 6) AS soft, round(CASE WHEN abs(amp) > 0.1 THEN amp ELSE 0 END, 6) AS hard, round(1 / (1 + exp(-amp)), 6) AS squashed FROM samples")
def thresholds(spark, sf):
    a = F.col("amp")
    return samples(spark, sf).select("trace", "idx", F.round(soft_threshold(a, 0.1), 6).alias("soft"), F.round(hard_threshold(a, 0.1), 6).alias("hard"), F.round(sigmoid(a), 6).alias("squashed"))
