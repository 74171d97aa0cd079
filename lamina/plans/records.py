"""Recovery, records, lookups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.carriers import FLUX, IMAGES, SAMPLES, SECTORS, flux, images, samples, sectors, table
from .base import query


@query("src09_size_score", "SELECT p_partkey AS path, CASE WHEN p_size IN (5, 10, 20, 40) THEN 1.0 WHEN p_size BETWEEN 8 AND 12 THEN 0.5 WHEN p_size BETWEEN 7 AND 14 THEN 0.3 ELSE 0.01 END AS score FROM part")
def size_score(spark, sf):
    valid = F.exists(F.array(*map(F.lit, (5, 10, 20, 40))), lambda s: s == F.col("p_size"))
    s = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.when(valid, 1.0).when(s.between(8, 12), 0.5).when(s.between(7, 14), 0.3).otherwise(0.01).alias("score"))


@query("src10_magic_score", f"WITH {IMAGES} SELECT image, CASE WHEN substr(data, 1, 4) = '5468' THEN 1.0 ELSE 0.5 * (CASE WHEN substr(data, 1, 2) = '54' THEN 1 ELSE 0 END + CASE WHEN substr(data, 3, 2) = '68' THEN 1 ELSE 0 END) / 2 END AS score FROM images WHERE chunk = 0")
def magic_score(spark, sf):
    magic = "5468"
    matched = F.aggregate(F.sequence(F.lit(1), F.lit(len(magic) // 2)), F.lit(0), lambda a, i: a + F.when(F.substring("data", i * 2 - 1, F.lit(2)) == F.substring(F.lit(magic), i * 2 - 1, F.lit(2)), 1).otherwise(0))
    return images(spark, sf).where("chunk = 0").select("image", F.when(matched == len(magic) // 2, 1.0).otherwise(matched * 0.5 / (len(magic) // 2)).alias("score"))


@query("src15_resolve_unique", """WITH p AS (SELECT c_mktsegment AS ext, c_nationkey AS id FROM customer), u AS (SELECT id, min(ext) AS ext FROM p GROUP BY id HAVING count(DISTINCT ext) = 1) SELECT n_nationkey AS id, u.ext AS plugin FROM nation LEFT JOIN u ON u.id = n_nationkey""")
def resolve_unique(spark, sf):
    u = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count_distinct("c_mktsegment").alias("n"), F.min("c_mktsegment").alias("plugin")).where("n = 1")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")).join(u, "id", "left").select("id", "plugin")


@query("io06_rpm", f"WITH {FLUX} SELECT track, idx, CASE WHEN dt > 0 THEN CAST(floor(60000000000.0 / dt) AS BIGINT) ELSE 0 END AS rpm FROM flux WHERE dt IS NOT NULL")
def rpm(spark, sf):
    return flux(spark, sf).where("dt IS NOT NULL").select("track", "idx", F.coalesce(F.floor(F.lit(60000000000.0) / F.nullif("dt", F.lit(0))), F.lit(0)).cast("long").alias("rpm"))


@query("io16_to_json", f"""WITH {SECTORS} SELECT track, '{{"sectors":' || count(*) || ',"bad":' || count(*) FILTER (NOT crc_ok) || '}}' AS report FROM sectors GROUP BY track""")
def to_json(spark, sf):
    return sectors(spark, sf).groupBy("track").agg(F.to_json(F.struct(F.count("*").alias("sectors"), F.count_if(~F.col("crc_ok")).alias("bad"))).alias("report"))


@query("scan03_pair_iterator", f"WITH {SAMPLES} SELECT a.trace, a.idx, a.amp AS left_amp, b.amp AS right_amp FROM samples a JOIN samples b ON b.trace = a.trace + 250 AND b.idx = a.idx")
def pair_iterator(spark, sf):
    s = samples(spark, sf).select("trace", "idx", "amp")
    b = s.select((F.col("trace") - 250).alias("trace"), "idx", F.col("amp").alias("right_amp"))
    return s.withColumnRenamed("amp", "left_amp").join(b, ["trace", "idx"])


@query("scan05_sector_lookup", f"WITH {SECTORS} SELECT track, arg_min(data, read) AS data FROM sectors WHERE sector = 3 GROUP BY track")
def sector_lookup(spark, sf):
    return sectors(spark, sf).where("sector = 3").groupBy("track").agg(F.min_by("data", "read").alias("data"))


@query("join08_self_verify", f"""WITH {SECTORS}, p AS (SELECT track, sector, count(*) AS reads, count(DISTINCT data) AS v FROM sectors GROUP BY 1, 2) SELECT track, count(*) FILTER (reads > 1 AND v = 1) AS verified, count(*) FILTER (reads > 1 AND v > 1) AS failed, count(*) FILTER (reads = 1) AS unread FROM p GROUP BY track""")
def self_verify(spark, sf):
    p = sectors(spark, sf).groupBy("track", "sector").agg(F.count("*").alias("reads"), F.count_distinct("data").alias("v"))
    two = F.col("reads") > 1
    return p.groupBy("track").agg(F.count_if(two & (F.col("v") == 1)).alias("verified"), F.count_if(two & (F.col("v") > 1)).alias("failed"), F.count_if(F.col("reads") == 1).alias("unread"))


@query("join06_zone_lookup", "WITH z AS (SELECT * FROM (VALUES (0, 17, 21), (17, 24, 19), (24, 30, 18), (30, 99, 17)) AS t(lo, hi, n)) SELECT p_partkey AS id, n AS per_track FROM part JOIN z ON p_size >= lo AND p_size < hi")
def zone_lookup(spark, sf):
    # Tracks of each speed zone and their sectors.
    z = spark.createDataFrame([(0, 17, 21), (17, 24, 19), (24, 30, 18), (30, 99, 17)], "lo int, hi int, n int")
    return table(spark, sf, "part").join(F.broadcast(z), (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi"))).select(F.col("p_partkey").alias("id"), F.col("n").alias("per_track"))


@query("fuse02_buffer_vote", f"""WITH {SAMPLES}, c AS (SELECT label, idx, CAST(floor(amp * 10) AS BIGINT) AS v, count(*) AS n FROM samples GROUP BY 1, 2, 3), t AS (SELECT label, idx, arg_max(v, (n, -v)) AS value, max(n) AS top, sum(n) AS total FROM c GROUP BY 1, 2)
  SELECT label, idx, value, CAST(top * 100 // total AS BIGINT) AS confidence, top < total AS weak FROM t""")
def buffer_vote(spark, sf):
    c = samples(spark, sf).groupBy("label", "idx", F.floor(F.col("amp") * 10).cast("long").alias("v")).agg(F.count("*").alias("n"))
    t = c.groupBy("label", "idx").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("value"), F.max("n").alias("top"), F.sum("n").alias("total"))
    return t.select("label", "idx", "value", F.expr("top * 100 div total").alias("confidence"), (F.col("top") < F.col("total")).alias("weak"))


@query("fuse10_bit_majority", f"""WITH {SAMPLES}, b AS (SELECT label, idx, count(*) FILTER (amp > 0) AS one, count(*) AS n FROM samples GROUP BY 1, 2), f AS (SELECT label, idx, one * 2 > n AS bit, one > 0 AND one < n AS weak FROM b)
  SELECT label, count(*) FILTER (bit) AS ones, count(*) FILTER (weak) AS weak_n, round(1 - count(*) FILTER (weak) / count(*), 6) AS quality FROM f GROUP BY label""")
def bit_majority(spark, sf):
    b = samples(spark, sf).groupBy("label", "idx").agg(F.count_if(F.col("amp") > 0).alias("one"), F.count("*").alias("n"))
    weak = F.count_if((F.col("one") > 0) & (F.col("one") < F.col("n")))
    return b.groupBy("label").agg(F.count_if(F.col("one") * 2 > F.col("n")).alias("ones"), weak.alias("weak_n"), F.round(1 - weak / F.count("*"), 6).alias("quality"))


@query("fuse19_partial", f"WITH {SECTORS}, g AS (SELECT t.track, s AS sector FROM (SELECT DISTINCT track FROM sectors) t, range(1, 8) AS r(s)), b AS (SELECT track, sector, arg_min(data, read) AS data FROM sectors WHERE crc_ok GROUP BY 1, 2) SELECT g.track, CAST(g.sector AS BIGINT) AS sector, coalesce(b.data, 0) AS data, b.data IS NOT NULL AS valid FROM g LEFT JOIN b ON b.track = g.track AND b.sector = g.sector")
def partial(spark, sf):
    s = sectors(spark, sf)
    grid = s.select("track").distinct().withColumn("sector", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))))
    best = s.where("crc_ok").groupBy("track", "sector").agg(F.min_by("data", "read").alias("d"))
    return grid.join(best, ["track", "sector"], "left").select("track", "sector", F.coalesce("d", F.lit(0)).alias("data"), F.col("d").isNotNull().alias("valid"))


@query("conv12_scan", f"WITH {SECTORS} SELECT track, count(DISTINCT sector) AS sectors, min(sector) AS first, max(sector) AS last, string_agg(DISTINCT CAST(sector AS VARCHAR), ' ' ORDER BY CAST(sector AS VARCHAR)) AS map FROM sectors GROUP BY track")
def scan_report(spark, sf):
    each = F.array_sort(F.collect_set(F.col("sector").cast("string")))
    return sectors(spark, sf).groupBy("track").agg(F.count_distinct("sector").alias("sectors"), F.min("sector").alias("first"), F.max("sector").alias("last"), F.array_join(each, " ").alias("map"))
