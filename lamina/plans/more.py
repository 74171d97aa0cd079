"""Coding round trips, repair, and the remaining lookups, reports and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..operators import windows as win
from ..sources.carriers import FLUX, IMAGES, SAMPLES, SECTORS, flux, images, samples, sectors, table
from .base import query


@query("dec35_quiet_mask", f"""WITH {SAMPLES}, v AS (SELECT trace, idx // 8 AS win, var_pop(amp) AS v FROM samples GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY v, win) AS k, count(*) OVER (PARTITION BY trace) AS n FROM v) SELECT trace, win FROM r WHERE k <= greatest(1, floor(n * 0.2))""")
def quiet_mask(spark, sf):
    v = samples(spark, sf).groupBy("trace", F.expr("idx div 8").alias("win")).agg(F.var_pop("amp").alias("v"))
    w = Window.partitionBy("trace")
    r = v.withColumns({"k": F.row_number().over(w.orderBy("v", "win")), "n": F.count("*").over(w)})
    return r.where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))).select("trace", "win")


@query("dec22_encoding_shares", f"""WITH {FLUX}, b AS (SELECT track, CASE WHEN dt < 7200000000 THEN 'SHORT' WHEN dt < 14400000000 THEN 'MID' ELSE 'LONG' END AS kind FROM flux WHERE dt > 0)
  SELECT track, CAST(100 * count(*) FILTER (kind = 'SHORT') // count(*) AS BIGINT) AS short, CAST(100 * count(*) FILTER (kind = 'MID') // count(*) AS BIGINT) AS mid, CAST(100 * count(*) FILTER (kind = 'LONG') // count(*) AS BIGINT) AS long FROM b GROUP BY track""")
def encoding_shares(spark, sf):
    dt, whole = F.col("dt"), F.count("*")
    share = lambda test: F.floor(F.count_if(test) * 100 / whole).cast("long")
    return flux(spark, sf).where("dt > 0").groupBy("track").agg(share(dt < 7200000000).alias("short"), share((dt >= 7200000000) & (dt < 14400000000)).alias("mid"), share(dt >= 14400000000).alias("long"))


@query("agg11_mad_sigma", f"WITH {SAMPLES}, m AS (SELECT trace, median(amp) AS med FROM samples GROUP BY trace) SELECT s.trace, round(1.4826 * median(abs(amp - med)), 6) AS sigma FROM samples s JOIN m USING (trace) GROUP BY s.trace")
def mad_sigma(spark, sf):
    m = samples(spark, sf).withColumn("med", F.median("amp").over(Window.partitionBy("trace")))
    return m.groupBy("trace").agg(F.round(F.median(F.abs(F.col("amp") - F.col("med"))) * 1.4826, 6).alias("sigma"))


@query("agg16_sector_counts", f"WITH {SECTORS} SELECT count(*) FILTER (crc_ok AND NOT weak) AS good, count(*) FILTER (NOT crc_ok) AS bad, count(*) FILTER (crc_ok AND weak) AS weak_n, count(*) AS total FROM sectors")
def sector_counts(spark, sf):
    ok, weak = F.col("crc_ok"), F.col("weak")
    return sectors(spark, sf).agg(F.count_if(ok & ~weak).alias("good"), F.count_if(~ok).alias("bad"), F.count_if(ok & weak).alias("weak_n"), F.count("*").alias("total"))


@query("agg17_map_counts", f"WITH {SECTORS}, p AS (SELECT track, sector, bool_or(crc_ok) AS ok FROM sectors GROUP BY 1, 2) SELECT track, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, 7 - count(*) AS empty FROM p GROUP BY track")
def map_counts(spark, sf):
    p = sectors(spark, sf).groupBy("track", "sector").agg(F.bool_or("crc_ok").alias("ok"))
    return p.groupBy("track").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"), (7 - F.count("*")).alias("empty"))


@query("io08_stream_stats", f"WITH {FLUX} SELECT track, min(dt) AS least, max(dt) AS most, round(60000000000.0 / max(dt), 6) AS min_rpm, round(60000000000.0 / avg(dt), 6) AS mean_rpm FROM flux WHERE dt > 0 GROUP BY track")
def stream_stats(spark, sf):
    return flux(spark, sf).where("dt > 0").groupBy("track").agg(F.min("dt").alias("least"), F.max("dt").alias("most"), F.round(F.lit(60000000000.0) / F.max("dt"), 6).alias("min_rpm"), F.round(F.lit(60000000000.0) / F.avg("dt"), 6).alias("mean_rpm"))


@query("io09_tick_histogram", f"WITH {FLUX} SELECT dt // 60000000 AS tick, count(*) AS n FROM flux WHERE dt IS NOT NULL AND dt // 60000000 <= 500 GROUP BY 1")
def tick_histogram(spark, sf):
    t = F.expr("dt div 60000000")
    return flux(spark, sf).where(t <= 500).groupBy(t.alias("tick")).agg(F.count("*").alias("n"))


@query("scan09_metadata_get", "SELECT event_id, try_cast(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def metadata_get(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.try_element_at(m, F.lit("k")).cast("long").alias("value"))


@query("scan11_list_keys", "SELECT user_id AS disk, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS keys FROM events GROUP BY 1")
def list_keys(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("disk")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("keys"))


@query("join19_fingerprint_compare", f"""WITH {FLUX}, b AS (SELECT track, least(dt // 600000000, 255) AS bin, count(*) AS n FROM flux WHERE dt IS NOT NULL GROUP BY 1, 2), m AS (SELECT track, sqrt(sum(n * n)) AS s FROM b GROUP BY track),
  d AS (SELECT x.track AS a, y.track AS b, sum(x.n * y.n) AS dot FROM b x JOIN b y ON x.bin = y.bin AND y.track = x.track + 1 GROUP BY 1, 2) SELECT d.a, d.b, round(dot / (p.s * q.s), 6) AS cosine FROM d JOIN m p ON p.track = d.a JOIN m q ON q.track = d.b""")
def fingerprint_compare(spark, sf):
    b = flux(spark, sf).where("dt IS NOT NULL").groupBy("track", F.least(F.expr("dt div 600000000"), F.lit(255).cast("long")).alias("bin")).agg(F.count("*").alias("n"))
    norm = b.groupBy("track").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("s"))
    y = b.select((F.col("track") - 1).alias("track"), "bin", F.col("n").alias("m"))
    d = b.join(y, ["track", "bin"]).groupBy("track").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    q = norm.select((F.col("track") - 1).alias("track"), F.col("s").alias("t"))
    return d.join(norm, "track").join(q, "track").select(F.col("track").alias("a"), (F.col("track") + 1).alias("b"), F.round(F.col("dot") / (F.col("s") * F.col("t")), 6).alias("cosine"))


@query("join20_title_lookup", "WITH k AS (SELECT * FROM (VALUES ('small widget', 'A'), ('large bolt', 'B')) AS t(title, scheme)) SELECT p_partkey AS id, scheme FROM part JOIN k ON k.title = lower(p_name)")
def title_lookup(spark, sf):
    k = spark.createDataFrame([("small widget", "A"), ("large bolt", "B")], "title string, scheme string")
    return table(spark, sf, "part").withColumn("title", F.lower("p_name")).join(F.broadcast(k), "title").select(F.col("p_partkey").alias("id"), "scheme")


@query("join09_bytes_equal", f"WITH {IMAGES}, a AS (SELECT image, chunk, data FROM images) SELECT x.image, bool_and(x.data = y.data) AS equal FROM a x JOIN a y ON y.image = x.image + 1 AND y.chunk = x.chunk GROUP BY x.image")
def bytes_equal(spark, sf):
    i = images(spark, sf)
    y = i.select((F.col("image") - 1).alias("image"), "chunk", F.col("data").alias("other"))
    return i.join(y, ["image", "chunk"]).groupBy("image").agg(F.bool_and(F.col("data") == F.col("other")).alias("equal"))


@query("fuse04_accept", f"""WITH {SECTORS}, c AS (SELECT track, sector, data, count(*) AS n, count(*) FILTER (crc_ok) AS g FROM sectors GROUP BY 1, 2, 3), v AS (SELECT track, sector, arg_max(data, (n, -data)) AS data, max(n) * 100 // sum(n) AS conf, sum(g) AS good FROM c GROUP BY 1, 2) SELECT track, sector, data, conf >= 60 AND good > 0 AS recovered FROM v""")
def accept(spark, sf):
    c = sectors(spark, sf).groupBy("track", "sector", "data").agg(F.count("*").alias("n"), F.count_if("crc_ok").alias("g"))
    v = c.groupBy("track", "sector").agg(F.max_by("data", F.struct("n", -F.col("data"))).alias("best"), F.max("n").alias("top"), F.sum("n").alias("all"), F.sum("g").alias("good"))
    return v.select("track", "sector", F.col("best").alias("data"), ((F.expr("top * 100 div all") >= 60) & (F.col("good") > 0)).alias("recovered"))


@query("fuse09_weak_regions", f"""WITH {SAMPLES}, m AS (SELECT label, idx, stddev_pop(amp) AS s FROM samples GROUP BY 1, 2), c AS (SELECT *, s > 0.125 AS weak FROM m), g AS (SELECT *, idx - row_number() OVER (PARTITION BY label ORDER BY idx) AS grp FROM c WHERE weak) SELECT label, min(idx) AS first, count(*) AS length, round(avg(s), 6) AS spread FROM g GROUP BY label, grp""")
def weak_regions(spark, sf):
    m = samples(spark, sf).groupBy("label", "idx").agg(F.stddev_pop("amp").alias("s"))
    r = win.runs(m, ["label"], "idx", F.col("s") > 0.125, F.round(F.avg("s"), 6).alias("spread"))
    return r.where("run_label").select("label", "first", "length", "spread")


@query("fs13_carry_checksum", f"WITH {IMAGES} SELECT image, chunk, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST('0x' || substr(data, CAST(i * 8 + 1 AS BIGINT), 8) AS BIGINT) FOR i IN range(0, length(data) // 8)]), lambda a, x: (a + x) % 4294967296 + (a + x) // 4294967296) AS BIGINT) AS checksum FROM images")
def carry_checksum(spark, sf):
    n = F.floor(F.length("data") / 8).cast("int")
    words = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring("data", i * 8 + 1, F.lit(8)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, x: (a + x) % 4294967296 + F.floor((a + x) / 4294967296))  # the carry comes round
    return images(spark, sf).select("image", "chunk", total.alias("checksum"))


@query("fn03_cosine_to_first", """WITH f AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS trace, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS cosine FROM embeddings, f""")
def cosine_to_first(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("e"))  # one vector
    return e.crossJoin(F.broadcast(first)).select(F.col("vec_id").alias("trace"), F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("cosine"))
