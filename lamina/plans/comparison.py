"""Positional joins: compare, verify, look up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..sources.carriers import IMAGES, SECTORS, images, sectors, table
from .base import query

PAIR = f"""{SECTORS}, a AS (SELECT track, sector, data, crc_ok, quality FROM sectors WHERE read = 0), b AS (SELECT track, sector, data, crc_ok, quality FROM sectors WHERE read = 1),
  v AS (SELECT coalesce(a.track, b.track) AS track, coalesce(a.sector, b.sector) AS sector, CASE WHEN a.track IS NULL THEN 'MISSING_IN_A' WHEN b.track IS NULL THEN 'MISSING_IN_B' WHEN a.quality IS DISTINCT FROM b.quality THEN 'SIZE'
  WHEN a.data IS DISTINCT FROM b.data THEN 'DATA' WHEN a.crc_ok IS DISTINCT FROM b.crc_ok THEN 'STATUS' ELSE 'IDENTICAL' END AS verdict FROM a FULL JOIN b ON a.track = b.track AND a.sector = b.sector)"""


def _pair(spark, sf):
    s = sectors(spark, sf)
    return cmp.positional(s.where("read = 0"), s.where("read = 1"), ["track", "sector"], "data", "crc_ok", "quality")


@query("join01_disk_compare", f"WITH {PAIR} SELECT track, sector, verdict FROM v")
def disk_compare(spark, sf):
    return _pair(spark, sf).select("track", "sector", "verdict")


@query("join04_chunk_compare", f"""WITH {IMAGES}, a AS (SELECT * FROM images WHERE image % 2 = 0), b AS (SELECT image - 1 AS image, chunk, data FROM images WHERE image % 2 = 1)
  SELECT coalesce(a.image, b.image) AS image, coalesce(a.chunk, b.chunk) AS chunk, a.data IS NULL AS missing_in_a, b.data IS NULL AS missing_in_b, coalesce(a.data = b.data, false) AS same FROM a FULL JOIN b ON a.image = b.image AND a.chunk = b.chunk""")
def chunk_compare(spark, sf):
    i = images(spark, sf)
    a = i.where("image % 2 = 0").withColumnRenamed("data", "da")
    b = i.where("image % 2 = 1").select((F.col("image") - 1).alias("image"), "chunk", F.col("data").alias("db"))
    return a.join(b, ["image", "chunk"], "full").select("image", "chunk", F.col("da").isNull().alias("missing_in_a"), F.col("db").isNull().alias("missing_in_b"), F.coalesce(F.col("da") == F.col("db"), F.lit(False)).alias("same"))


@query("join13_byte_difference", """WITH p AS (SELECT c_custkey AS id, hex(encode(c_name)) AS a, hex(encode(c_mktsegment)) AS b FROM customer)
  SELECT id, CAST((SELECT count(*) FROM range(0, least(length(a), length(b)) // 2) AS r(i) WHERE substr(a, i * 2 + 1, 2) <> substr(b, i * 2 + 1, 2)) + abs(length(a) - length(b)) // 2 AS BIGINT) AS differing FROM p""")
def byte_difference(spark, sf):
    h = lambda c: F.hex(F.encode(c, "utf-8"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), cmp.hex_bytes_differing(h("c_name"), h("c_mktsegment")).alias("differing"))


@query("join07_verify", f"""WITH {PAIR} SELECT track, count(*) AS checked, count(*) FILTER (verdict = 'IDENTICAL') AS same, CASE WHEN count(*) FILTER (verdict <> 'IDENTICAL') = 0 THEN 'OK' ELSE 'FAILED' END AS status FROM v WHERE verdict NOT LIKE 'MISSING%' GROUP BY track""")
def verify(spark, sf):
    ok = F.count_if(F.col("verdict") == "IDENTICAL")
    v = _pair(spark, sf).where("verdict NOT LIKE 'MISSING%'")
    return v.groupBy("track").agg(F.count("*").alias("checked"), ok.alias("same"), F.when(ok == F.count("*"), "OK").otherwise("FAILED").alias("status"))


@query("join10_weak_tolerant", f"""WITH {SECTORS}, p AS (SELECT a.track, a.sector, a.weak OR b.weak OR a.data = b.data AS fine FROM sectors a JOIN sectors b ON a.track = b.track AND a.sector = b.sector AND a.read = 0 AND b.read = 1) SELECT track, bool_and(fine) AS verified FROM p GROUP BY track""")
def weak_tolerant(spark, sf):
    s = sectors(spark, sf)
    b = s.where("read = 1").select("track", "sector", F.col("data").alias("d1"), F.col("weak").alias("w1"))
    p = s.where("read = 0").join(b, ["track", "sector"])
    return p.groupBy("track").agg(F.bool_and(F.col("weak") | F.col("w1") | (F.col("data") == F.col("d1"))).alias("verified"))


@query("join17_status_or_default", """WITH m AS (SELECT * FROM (VALUES ('EUROPE', 'ASIA', 'LOSSLESS'), ('ASIA', 'AFRICA', 'LOSSY')) AS t(src, dst, status)) SELECT a.r_name AS src, b.r_name AS dst, coalesce(status, 'UNTESTED') AS status FROM region a CROSS JOIN region b LEFT JOIN m ON m.src = a.r_name AND m.dst = b.r_name""")
def status_or_default(spark, sf):
    r = table(spark, sf, "region").select("r_name")
    m = spark.createDataFrame([("EUROPE", "ASIA", "LOSSLESS"), ("ASIA", "AFRICA", "LOSSY")], "src string, dst string, status string")
    pairs = r.select(F.col("r_name").alias("src")).crossJoin(r.select(F.col("r_name").alias("dst")))  # a dimension of a few rows
    return cmp.left_default(pairs, F.broadcast(m), ["src", "dst"], "status", "UNTESTED").select("src", "dst", "status")


@query("set01_multiset_difference", "SELECT c_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def multiset_difference(spark, sf):
    d = table(spark, sf, "customer").select("c_nationkey").exceptAll(table(spark, sf, "supplier").select("s_nationkey"))
    return d.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
