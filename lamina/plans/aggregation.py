"""Aggregations over tracks, sectors and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..sources.carriers import FLUX, SAMPLES, SECTORS, flux, samples, sectors
from .base import query


@query("agg01_disk_stats", f"""WITH {SECTORS} SELECT track, count(*) AS total, count(*) FILTER (crc_ok) AS ok, count(*) FILTER (NOT crc_ok) AS crc_error,
  count(*) FILTER (weak) AS weak_n, count(*) FILTER (deleted) AS deleted_n, round(count(*) FILTER (crc_ok) / count(*), 6) AS health
  FROM sectors GROUP BY GROUPING SETS ((track), ())""")
def disk_stats(spark, sf):
    ok = F.count_if("crc_ok")
    return sectors(spark, sf).groupingSets([["track"], []], "track").agg(
        F.count("*").alias("total"), ok.alias("ok"), F.count_if(~F.col("crc_ok")).alias("crc_error"), F.count_if("weak").alias("weak_n"),
        F.count_if("deleted").alias("deleted_n"), F.round(ok / F.count("*"), 6).alias("health"))


@query("agg03_health_score", f"WITH {SECTORS} SELECT CAST(floor(count(*) FILTER (crc_ok) / count(*) * 100 + 0.5) AS BIGINT) AS score FROM sectors")
def health_score(spark, sf):
    return sectors(spark, sf).agg(F.floor(F.count_if("crc_ok") / F.count("*") * 100 + 0.5).cast("long").alias("score"))


@query("agg04_interval_stats", f"""WITH {FLUX}, d AS (SELECT track, dt // 1000000 AS dt FROM flux WHERE dt IS NOT NULL), m AS (SELECT track, CAST(floor(avg(dt)) AS BIGINT) AS mean FROM d GROUP BY track)
  SELECT d.track, count(*) AS n, min(dt) AS least, max(dt) AS most, any_value(mean) AS mean, round(sqrt(avg((dt - mean) * (dt - mean))), 6) AS deviation FROM d JOIN m USING (track) GROUP BY d.track""")
def interval_stats(spark, sf):
    d = flux(spark, sf).where("dt IS NOT NULL").select("track", F.expr("dt div 1000000").alias("dt"))
    mean = F.floor(F.avg("dt").over(Window.partitionBy("track"))).cast("long")  # integer mean, and the deviation around it
    return d.withColumn("mean", mean).groupBy("track").agg(
        F.count("*").alias("n"), F.min("dt").alias("least"), F.max("dt").alias("most"), F.max("mean").alias("mean"),
        F.round(F.sqrt(F.avg((F.col("dt") - F.col("mean")) * (F.col("dt") - F.col("mean")))), 6).alias("deviation"))


BINS = "bins AS (SELECT track, least(dt // 600000000, 255) AS bin, count(*) AS n FROM flux WHERE dt IS NOT NULL GROUP BY 1, 2)"


def _bins(spark, sf):
    return flux(spark, sf).where("dt IS NOT NULL").groupBy("track", F.least(F.expr("dt div 600000000"), F.lit(255).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


@query("agg05_timing_histogram", f"WITH {FLUX}, {BINS} SELECT track, bin, n FROM bins")
def timing_histogram(spark, sf):
    return _bins(spark, sf)


@query("io10_histogram_peaks", f"""WITH {FLUX}, {BINS}, p AS (SELECT track, bin, n, coalesce(lag(CASE WHEN true THEN n END) OVER w, 0) AS l, lag(bin) OVER w AS lb,
  lead(n) OVER w AS r, lead(bin) OVER w AS rb FROM bins WINDOW w AS (PARTITION BY track ORDER BY bin))
  SELECT track, bin, n FROM p WHERE n > CASE WHEN lb = bin - 1 THEN l ELSE 0 END AND n >= CASE WHEN rb = bin + 1 THEN r ELSE 0 END""")
def histogram_peaks(spark, sf):
    w = Window.partitionBy("track").orderBy("bin")
    near = lambda v, step: F.when((F.lag if step < 0 else F.lead)("bin").over(w) == F.col("bin") + step, (F.lag if step < 0 else F.lead)("n").over(w)).otherwise(0)
    p = _bins(spark, sf).withColumns({"l": near("n", -1), "r": near("n", 1)})
    return p.where("n > l AND n >= r").select("track", "bin", "n")


@query("agg06_track_stats", f"""WITH {FLUX} SELECT track, round(avg(amp), 6) AS mean, round(sqrt(avg(amp * amp)), 6) AS rms, max(abs(amp)) AS peak,
  list_sort(list(amp))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95 FROM flux GROUP BY track""")
def track_stats(spark, sf):
    ordered = F.array_sort(F.collect_list("amp"))
    return flux(spark, sf).groupBy("track").agg(
        F.round(F.avg("amp"), 6).alias("mean"), F.round(F.sqrt(F.avg(F.col("amp") * F.col("amp"))), 6).alias("rms"), F.max(F.abs("amp")).alias("peak"),
        F.try_element_at(ordered, (F.floor(F.count("*") * 0.95) + 1).cast("int")).alias("p95"))


@query("agg07_worst_track", f"""WITH {FLUX}, t AS (SELECT track, sqrt(avg(amp * amp)) AS rms FROM flux GROUP BY track)
  SELECT round(avg(rms), 6) AS mean_rms, arg_max(track, (rms, -track)) AS worst FROM t""")
def worst_track(spark, sf):
    t = flux(spark, sf).groupBy("track").agg(F.sqrt(F.avg(F.col("amp") * F.col("amp"))).alias("rms"))
    return t.agg(F.round(F.avg("rms"), 6).alias("mean_rms"), F.max_by("track", F.struct("rms", -F.col("track"))).alias("worst"))


@query("agg08_heat_map", f"""WITH {FLUX}, c AS (SELECT track, count(*) AS n FROM flux GROUP BY track), g AS (SELECT track, s FROM c, range(0, 128) AS r(s)),
  p AS (SELECT f.track, idx * 128 // n AS s, avg(amp) AS a FROM flux f JOIN c USING (track) GROUP BY 1, 2)
  SELECT g.track, CAST(g.s AS BIGINT) AS slice, coalesce(round(a, 6), -60.0) AS level FROM g LEFT JOIN p ON g.track = p.track AND g.s = p.s""")
def heat_map(spark, sf):
    f = flux(spark, sf)
    n = F.count("*").over(Window.partitionBy("track"))
    p = f.withColumn("slice", F.expr("idx * 128") / n).withColumn("slice", F.floor("slice")).groupBy("track", "slice").agg(F.round(F.avg("amp"), 6).alias("a"))
    grid = f.select("track").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(127).cast("long"))))
    return grid.join(p, ["track", "slice"], "left").select("track", "slice", F.coalesce("a", F.lit(-60.0)).alias("level"))


@query("agg09_rollup_of_kinds", f"""WITH {FLUX}, t AS (SELECT track, bool_or(label = 'error') AS e, bool_or(label = 'purchase') AS p FROM flux GROUP BY track)
  SELECT count(*) AS tracks, count(*) FILTER (e) AS with_error, count(*) FILTER (p) AS with_purchase, bool_or(e AND p) AS both FROM t""")
def rollup_of_kinds(spark, sf):
    t = flux(spark, sf).groupBy("track").agg(F.bool_or(F.col("label") == "error").alias("e"), F.bool_or(F.col("label") == "purchase").alias("p"))
    return t.agg(F.count("*").alias("tracks"), F.count_if("e").alias("with_error"), F.count_if("p").alias("with_purchase"), F.bool_or(F.col("e") & F.col("p")).alias("both"))


@query("agg10_robust_stats", f"""WITH {FLUX}, m AS (SELECT track, median(amp) AS med FROM flux GROUP BY track),
  r AS (SELECT track, amp, row_number() OVER (PARTITION BY track ORDER BY amp, idx) AS k, count(*) OVER (PARTITION BY track) AS n FROM flux),
  t AS (SELECT track, avg(amp) AS trimmed FROM r WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY track)
  SELECT f.track, round(any_value(med), 6) AS med, round(any_value(trimmed), 6) AS trimmed, round(median(abs(amp - med)), 6) AS mad, round(1.4826 * median(abs(amp - med)), 6) AS sigma
  FROM flux f JOIN m USING (track) JOIN t USING (track) GROUP BY f.track""")
def robust_stats(spark, sf):
    f = flux(spark, sf)
    w = Window.partitionBy("track")
    cut = F.floor(F.count("*").over(w) * 0.1)
    r = f.withColumns({"k": F.row_number().over(w.orderBy("amp", "idx")), "n": F.count("*").over(w), "cut": cut, "med": F.median("amp").over(w)})
    dev = F.median(F.abs(F.col("amp") - F.col("med")))
    return r.groupBy("track").agg(
        F.round(F.max("med"), 6).alias("med"), F.round(F.avg(F.when((F.col("k") > F.col("cut")) & (F.col("k") <= F.col("n") - F.col("cut")), F.col("amp"))), 6).alias("trimmed"),
        F.round(dev, 6).alias("mad"), F.round(dev * 1.4826, 6).alias("sigma"))


@query("agg12_confidence_summary", f"""WITH {SECTORS}, c AS (SELECT track, quality / 50.0 AS x FROM sectors)
  SELECT track, round(avg(x), 6) AS mean, round(median(x), 6) AS med, round(avg(CASE WHEN x >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS high,
  round(avg(CASE WHEN x >= 0.4 AND x < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS mid, round(0.6 * avg(x) + 0.4 * avg(CASE WHEN x >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS overall FROM c GROUP BY track""")
def confidence_summary(spark, sf):
    x = F.col("quality") / 50.0
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return sectors(spark, sf).groupBy("track").agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.median(x), 6).alias("med"), F.round(share(x >= 0.8), 6).alias("high"), F.round(share((x >= 0.4) & (x < 0.8)), 6).alias("mid"),
        F.round(F.avg(x) * 0.6 + share(x >= 0.8) * 0.4, 6).alias("overall"))


@query("agg15_quick_scan", f"""WITH {SECTORS}, t AS (SELECT track, count(*) AS n, count(*) FILTER (crc_ok) AS ok FROM sectors GROUP BY track),
  c AS (SELECT CASE WHEN ok = 0 THEN 'UNREADABLE' WHEN n = 1 THEN 'BLANK' WHEN ok < n THEN 'DEGRADED' ELSE 'GOOD' END AS status FROM t)
  SELECT status, count(*) AS tracks, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c GROUP BY status""")
def quick_scan(spark, sf):
    t = sectors(spark, sf).groupBy("track").agg(F.count("*").alias("n"), F.count_if("crc_ok").alias("ok"))
    status = F.when(F.col("ok") == 0, "UNREADABLE").when(F.col("n") == 1, "BLANK").when(F.col("ok") < F.col("n"), "DEGRADED").otherwise("GOOD")
    by = t.groupBy(status.alias("status")).agg(F.count("*").alias("tracks"))  # at most four rows reach the window below
    return by.withColumn("percent", F.round(F.col("tracks") * 100.0 / F.sum("tracks").over(Window.partitionBy()), 6))


@query("agg18_surface_scan", f"""WITH {SECTORS}, s AS (SELECT track, sector, bool_or(crc_ok) AS good, arg_min(crc_ok, read) AS at_once FROM sectors GROUP BY track, sector)
  SELECT track, count(*) FILTER (at_once) AS good, count(*) FILTER (good AND NOT at_once) AS weak, count(*) FILTER (NOT good) AS bad, round(100.0 * count(*) FILTER (good) / count(*), 6) AS quality FROM s GROUP BY track""")
def surface_scan(spark, sf):
    s = sectors(spark, sf).groupBy("track", "sector").agg(F.bool_or("crc_ok").alias("fine"), F.min_by("crc_ok", "read").alias("at_once"))
    return s.groupBy("track").agg(F.count_if("at_once").alias("good"), F.count_if(F.col("fine") & ~F.col("at_once")).alias("weak"), F.count_if(~F.col("fine")).alias("bad"),
                                  F.round(F.count_if("fine") * 100.0 / F.count("*"), 6).alias("quality"))


@query("agg24_anomaly_train", f"WITH {SAMPLES} SELECT idx, round(avg(amp), 6) AS mean, round(var_samp(amp), 6) AS variance FROM samples GROUP BY idx")
def anomaly_train(spark, sf):
    return samples(spark, sf).groupBy("idx").agg(F.round(F.avg("amp"), 6).alias("mean"), F.round(F.var_samp("amp"), 6).alias("variance"))


@query("agg26_features", f"""WITH {FLUX}, {BINS}, p AS (SELECT track, n / sum(n) OVER (PARTITION BY track) AS p FROM bins)
  SELECT track, round(-sum(p * ln(p)) / ln(256), 6) AS entropy, round(max(p), 6) AS top, count(*) AS used FROM p GROUP BY track""")
def track_features(spark, sf):
    p = _bins(spark, sf).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("track")))
    return p.groupBy("track").agg(F.round(-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(256.0)), 6).alias("entropy"), F.round(F.max("p"), 6).alias("top"), F.count("*").alias("used"))


@query("agg28_fingerprint", f"""WITH {FLUX}, {BINS}, h AS (SELECT track, bin, n / sum(n) OVER (PARTITION BY track) AS p FROM bins)
  SELECT track, md5(string_agg(bin || ':' || CAST(CAST(floor(p * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY bin)) AS fingerprint FROM h GROUP BY track""")
def fingerprint(spark, sf):
    h = _bins(spark, sf).withColumn("p", F.floor(F.col("n") / F.sum("n").over(Window.partitionBy("track")) * 1000000))
    each = F.array_sort(F.collect_list(F.struct("bin", "p")))  # 256 bins at most
    return h.groupBy("track").agg(F.md5(F.array_join(F.transform(each, lambda s: F.concat_ws(":", s["bin"], s["p"])), ",")).alias("fingerprint"))


@query("agg29_aging_track", f"""WITH {FLUX}, r AS (SELECT track, regr_slope(amp, idx) AS b, regr_intercept(amp, idx) AS a, greatest(0.0, regr_r2(amp, idx)) AS r2 FROM flux GROUP BY track)
  SELECT f.track, round(any_value(b), 6) AS slope, round(any_value(r2), 6) AS r2, round(max(abs(amp - a - b * idx)), 6) AS residual FROM flux f JOIN r USING (track) GROUP BY f.track""")
def aging_track(spark, sf):
    f = flux(spark, sf)
    y, x = F.col("amp"), F.col("idx").cast("double")
    r = f.groupBy("track").agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.greatest(F.lit(0.0), F.regr_r2(y, x)).alias("r2"))
    return f.join(r, "track").groupBy("track").agg(F.round(F.max("b"), 6).alias("slope"), F.round(F.max("r2"), 6).alias("r2"), F.round(F.max(F.abs(y - F.col("a") - F.col("b") * x)), 6).alias("residual"))


@query("agg30_aging_disk", f"""WITH {FLUX}, r AS (SELECT track, regr_slope(amp, idx) AS b, avg(amp) AS level FROM flux GROUP BY track)
  SELECT round(avg(b), 6) AS mean_slope, round(regr_slope(level, track), 8) AS gradient FROM r""")
def aging_disk(spark, sf):
    r = flux(spark, sf).groupBy("track").agg(F.regr_slope("amp", F.col("idx").cast("double")).alias("b"), F.avg("amp").alias("level"))
    return r.agg(F.round(F.avg("b"), 6).alias("mean_slope"), F.round(F.regr_slope("level", F.col("track").cast("double")), 8).alias("gradient"))


@query("agg33_weak_cells", f"""WITH {SECTORS} SELECT track, sector, count(*) AS reads, round(avg(quality), 6) AS mean, round(stddev_pop(quality), 6) AS jitter, stddev_pop(quality) > 10 AS weak FROM sectors GROUP BY track, sector""")
def weak_cells(spark, sf):
    j = F.stddev_pop("quality")
    return sectors(spark, sf).groupBy("track", "sector").agg(F.count("*").alias("reads"), F.round(F.avg("quality"), 6).alias("mean"), F.round(j, 6).alias("jitter"), (j > 10).alias("weak"))


@query("agg22_confidence_blend", f"""WITH {SECTORS} SELECT track, sector, read, round(least(1.0, greatest(0.0, 0.2 * quality / 50 + 0.3 * CAST(NOT weak AS INT) + 0.35 * CAST(crc_ok AS INT) + 0.15 * CAST(NOT deleted AS INT))), 6) AS confidence FROM sectors""")
def confidence_blend(spark, sf):
    bit = lambda c: c.cast("double")
    x = F.col("quality") * 0.2 / 50 + bit(~F.col("weak")) * 0.3 + bit(F.col("crc_ok")) * 0.35 + bit(~F.col("deleted")) * 0.15
    return sectors(spark, sf).select("track", "sector", "read", F.round(clamp(x, 0.0, 1.0), 6).alias("confidence"))
