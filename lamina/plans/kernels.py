"""Decode kernels and checksums: ordered state that SQL has no short form for (tests hold them against loops)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.carriers import FLUX, SAMPLES, flux, samples, table
from .base import query


#: A table of 256 values by the polynomial's rule, stepped over the bytes.
_CRC = """WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS tab FROM range(256) AS r(i)),
  d AS (SELECT doc_id AS image, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)
  SELECT image, CASE WHEN b IS NOT NULL THEN xor(list_reduce(list_transform(b, lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) END AS crc FROM d, crc"""


@query("fn02_crc32", _CRC)
def crc32(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("image"), F.crc32("text").alias("crc"))


@query("dec21_encoding", f"""WITH {FLUX}, m AS (SELECT track, avg(dt) / 3.6e9 AS h FROM flux WHERE dt > 0 AND idx <= 1000 GROUP BY track) SELECT track, CASE WHEN h < 4 THEN 'MFM' WHEN h < 8 THEN 'GCR' ELSE 'FM' END AS encoding FROM m""")
def encoding(spark, sf):
    m = flux(spark, sf).where("dt > 0 AND idx <= 1000").groupBy("track").agg((F.avg("dt") / 3.6e9).alias("h"))
    return m.select("track", F.when(F.col("h") < 4, "MFM").when(F.col("h") < 8, "GCR").otherwise("FM").alias("encoding"))


@query("dec33_haar", f"""WITH {SAMPLES}, n AS (SELECT trace, count(*) AS n FROM samples GROUP BY trace) SELECT a.trace, a.idx, round((a.amp + b.amp) / 2, 6) AS approx, round((a.amp - b.amp) / 2, 6) AS detail
  FROM samples a JOIN n USING (trace) JOIN samples b ON b.trace = a.trace AND b.idx = (a.idx + n.n - 1) % n.n""")
def haar(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("trace").orderBy("idx")
    last = F.last("amp").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.lag("amp").over(w), last)  # the shift is circular
    return samples(spark, sf).select("trace", "idx", F.round((F.col("amp") + before) / 2, 6).alias("approx"), F.round((F.col("amp") - before) / 2, 6).alias("detail"))
