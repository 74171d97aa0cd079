"""Loops over intervals: cells, filters, change points. The SQL steps the same recurrence row by row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lanes
from ..sources.carriers import FLUX, PULSES, SAMPLES, flux, pulses, samples
from .base import query


def recurrence(source: str, name: str, value: str, start: str, steps: list[str], pick: str) -> str:
    """A recursive query over a source of (track, idx, value): steps are select lists, each over the one before."""
    inner = f"(SELECT c.*, p.{value}, p.idx AS nxt FROM c JOIN {name} p ON p.track = c.track AND p.idx = c.idx + 1)"
    for s in steps[:-1]:
        inner = f"(SELECT *, {s} FROM {inner})"
    return f"WITH RECURSIVE {source}, c AS (SELECT track, CAST(-1 AS BIGINT) AS idx, {start} FROM (SELECT DISTINCT track FROM {name}) UNION ALL SELECT track, nxt, {steps[-1]} FROM {inner}) {pick}"


FIXED = recurrence(PULSES, "pulses", "dt", "CAST(0 AS BIGINT) AS n, CAST(2000 AS BIGINT) AS cell, false AS held",
                   ["(dt + cell // 2) // cell AS raw", "greatest(1, least(4, raw)) AS k", "CAST(k AS BIGINT), CAST(greatest(1500, least(2800, cell + floor((dt - k * cell) * 3277 / 65536.0))) AS BIGINT), raw > 4"],
                   "SELECT track, idx, n AS cells, cell, held FROM c WHERE idx >= 0")


@query("dec01_pll", FIXED)
def fixed_point_loop(spark, sf):
    start, step = lanes.fixed_loop(2000, 1500, 2800, 3277, 4)
    return lanes.scan(pulses(spark, sf), "track", "idx", ["dt"], start, step, "cells long, cell long, held boolean")


PHASE = recurrence(PULSES, "pulses", "dt", "CAST(0 AS BIGINT) AS n, 2000.0::DOUBLE AS period, 0.0::DOUBLE AS phase",
                   ["greatest(dt - phase, 0.0) AS t", "greatest(1, least(8, floor(t / period + 0.5))) AS k", "t - k * period AS err",
                    "CAST(k AS BIGINT), greatest(1600.0, least(2400.0, period + err * 0.05 / k)), greatest(-period * 0.5, least(period * 0.5, (1.0 - 0.5) * phase + 0.5 * err))"],
                   "SELECT track, idx, n AS cells, round(period, 6) AS period FROM c WHERE idx >= 0")


def _phase(spark, sf):
    start, step = lanes.phase_loop(2000.0, 0.5, 0.05)
    return lanes.scan(pulses(spark, sf), "track", "idx", ["dt"], start, step, "cells long, period double")


@query("dec02_phase_loop", PHASE)
def phase_loop(spark, sf):
    return _phase(spark, sf).withColumn("period", F.round("period", 6))


_K = dict(cell=2000.0, low=1600.0, high=2400.0, q_cell=1.0, q_drift=0.01, noise=100.0, weak=3.0, most=8)
KALMAN_STEPS = ["dt < x * 0.25 OR dt > x * 9 * 1.5 AS bad, x + drift AS px, p00 + 2 * p01 + p11 + 1.0 AS q00, p01 + p11 AS q01, p11 + 0.01 AS q11", "greatest(1.0, least(8.0, floor(dt / px + 0.5))) AS k", "dt - k * px AS inn, k * k * q00 + 100.0 AS s",
                "abs(inn) / sqrt(s) AS z, q00 * k / s AS k0, q01 * k / s AS k1",
                """CASE WHEN bad THEN 0 ELSE CAST(k AS BIGINT) END, CASE WHEN bad THEN x ELSE greatest(1600.0, least(2400.0, px + k0 * inn)) END, CASE WHEN bad THEN drift ELSE drift + k1 * inn END, CASE WHEN bad THEN p00 ELSE greatest((1 - k0 * k) * q00, 0.01) END,
  CASE WHEN bad THEN p01 ELSE (1 - k0 * k) * q01 END, CASE WHEN bad THEN p11 ELSE greatest(q11 - k1 * k * q01, 0.0001) END, CASE WHEN bad THEN 0.0 ELSE 1 - greatest(0.0, least(1.0, z / 6.0)) END, NOT bad AND z > 3.0"""]
KALMAN = recurrence(PULSES, "pulses", "dt", "CAST(0 AS BIGINT) AS n, 2000.0::DOUBLE AS x, 0.0::DOUBLE AS drift, (800.0 * 800.0 / 12)::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS conf, false AS weak", KALMAN_STEPS, "")


def _kalman(spark, sf):
    start, step = lanes.kalman_loop(**_K)
    return lanes.scan(pulses(spark, sf), "track", "idx", ["dt"], start, step, "cells long, cell double, confidence double, weak boolean")


@query("dec03_kalman", KALMAN + "SELECT track, idx, n AS cells, round(x, 4) AS cell, round(conf, 4) AS confidence, weak FROM c WHERE idx >= 0")
def kalman_step(spark, sf):
    return _kalman(spark, sf).withColumns({"cell": F.round("cell", 4), "confidence": F.round("confidence", 4)})


@query("dec04_kalman_decode", KALMAN + """SELECT track, CAST(sum(n) AS BIGINT) AS bits, string_agg(CASE WHEN n > 0 THEN repeat('0', n - 1) || '1' ELSE '' END, '' ORDER BY idx) AS cells, count(*) FILTER (n = 0) AS dropped, count(*) FILTER (weak) AS weak,
  round(arg_max(x, idx), 4) AS final_cell FROM c WHERE idx >= 0 GROUP BY track""")
def kalman_decode(spark, sf):
    """Bit cells of each track: as many zeros as cells less one, then a one; rejected spikes give none."""
    k = _kalman(spark, sf)
    one = F.struct("idx", F.when(F.col("cells") > 0, F.concat(F.repeat(F.lit("0"), (F.col("cells") - 1).cast("int")), F.lit("1"))).otherwise("").alias("b"))
    return k.groupBy("track").agg(F.sum("cells").alias("bits"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["b"]), "").alias("cells"), F.count_if(F.col("cells") == 0).alias("dropped"),
                                  F.count_if("weak").alias("weak"), F.round(F.max_by("cell", "idx"), 4).alias("final_cell"))


SIMPLE = recurrence(PULSES, "pulses", "dt", "CAST(0 AS BIGINT) AS n, 2000.0::DOUBLE AS x, 10000.0::DOUBLE AS var, 0.0::DOUBLE AS cnt, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS m2, false AS odd",
                    ["greatest(1.0, least(5.0, floor(dt / x + 0.5))) AS k, var + 1.0 AS pv", "dt / k AS each, pv / (pv + 2500.0) AS gain", "cnt >= 4 AND abs(each - mean) / sqrt(greatest(m2 / greatest(cnt, 1), 1.0)) > 3.0 AS out, each - mean AS d", "mean + d / (cnt + 1) AS nm",
                     "CAST(k AS BIGINT), CASE WHEN out THEN x ELSE x + gain * ((dt - x * k) / k) END, CASE WHEN out THEN var ELSE (1 - gain) * pv END, CASE WHEN out THEN cnt ELSE cnt + 1 END, CASE WHEN out THEN mean ELSE nm END, CASE WHEN out THEN m2 ELSE m2 + d * (each - nm) END, out"],
                    "SELECT track, idx, n AS cells, round(x, 4) AS cell, odd AS outlier FROM c WHERE idx >= 0")


@query("dec05_simple_kalman", SIMPLE)
def simple_kalman(spark, sf):
    start, step = lanes.simple_kalman_loop(2000.0, 10000.0, 1.0, 2500.0)
    return lanes.scan(pulses(spark, sf), "track", "idx", ["dt"], start, step, "cells long, cell double, outlier boolean").withColumn("cell", F.round("cell", 4))


@query("win23_cusum", recurrence(f"{FLUX}, m AS (SELECT track, avg(amp) AS mu FROM flux GROUP BY track), x AS (SELECT f.track, idx, amp - mu AS v FROM flux f JOIN m USING (track))", "x", "v", "0.0::DOUBLE AS p, 0.0::DOUBLE AS n, false AS hit",
                                 ["greatest(0, p + v - 5) AS np, greatest(0, n - v - 5) AS nn", "np > 100 OR nn > 100 AS h", "CASE WHEN h THEN 0 ELSE np END, CASE WHEN h THEN 0 ELSE nn END, h"], "SELECT track, idx FROM c WHERE hit"))
def cusum(spark, sf):
    f = flux(spark, sf)
    x = f.withColumn("v", F.col("amp") - F.avg("amp").over(Window.partitionBy("track")))
    start, step = lanes.change_loop(5.0, 100.0)
    return lanes.scan(x, "track", "idx", ["v"], start, step, "hit boolean").where("hit").select("track", "idx")


#: Envelope points of each trace: every fourth sample, with the level and the signal-to-noise ratio of the eight up to it.
POINTS = f"""{SAMPLES}, z AS (SELECT trace, idx, amp - avg(amp) OVER (PARTITION BY trace) AS x FROM samples), e AS (SELECT trace, idx, sqrt(avg(x * x) OVER w) AS rms, abs(avg(x) OVER w) AS m, stddev_pop(x) OVER w AS s FROM z WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS 7 PRECEDING)),
  points AS (SELECT trace AS track, idx // 4 AS idx, round(rms, 9) AS rms, round(CASE WHEN s > 1e-9 AND m > 1e-12 THEN greatest(-60.0, least(60.0, 20 * log10(m / s))) ELSE -60.0 END, 6) AS snr FROM e WHERE idx % 4 = 0)"""


def _points(spark, sf):
    z = samples(spark, sf).withColumn("x", F.col("amp") - F.avg("amp").over(Window.partitionBy("trace")))
    w = Window.partitionBy("trace").orderBy("idx").rowsBetween(-7, 0)
    e = z.withColumns({"rms": F.sqrt(F.avg(F.col("x") * F.col("x")).over(w)), "m": F.abs(F.avg("x").over(w)), "s": F.stddev_pop("x").over(w)}).where("idx % 4 = 0")
    snr = F.when((F.col("s") > 1e-9) & (F.col("m") > 1e-12), F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.log10(F.col("m") / F.nullif("s", F.lit(0.0))) * 20))).otherwise(F.lit(-60.0))
    return e.select(F.col("trace").alias("track"), F.expr("idx div 4").alias("idx"), F.round("rms", 9).alias("rms"), F.round(snr, 6).alias("snr"))


CHANGES = recurrence(f"{POINTS}, m AS (SELECT track, avg(snr) AS mu FROM points GROUP BY track), x AS (SELECT f.track, idx, round(snr - mu, 6) AS v FROM points f JOIN m USING (track))", "x", "v", "0.0::DOUBLE AS p, 0.0::DOUBLE AS n, false AS hit",
                     ["greatest(0, p + v - 1) AS np, greatest(0, n - v - 1) AS nn", "np > 20 OR nn > 20 AS h", "CASE WHEN h THEN 0 ELSE np END, CASE WHEN h THEN 0 ELSE nn END, h"], "")


def _changes(spark, sf):
    """The points with where their ratio changes."""
    p = _points(spark, sf)
    x = p.withColumn("v", F.round(F.col("snr") - F.avg("snr").over(Window.partitionBy("track")), 6))
    start, step = lanes.change_loop(1.0, 20.0)
    return p.join(lanes.scan(x, "track", "idx", ["v"], start, step, "hit boolean"), ["track", "idx"])


@query("win24_ratio_changes", CHANGES + "SELECT track, idx FROM c WHERE hit")
def ratio_changes(spark, sf):
    return _changes(spark, sf).where("hit").select("track", "idx")


@query("win27_analyse", CHANGES + "SELECT p.track, p.idx, p.rms, p.snr, c.hit AS change FROM points p JOIN c ON c.track = p.track AND c.idx = p.idx")
def analyse(spark, sf):
    """Level, ratio and change mark of every envelope point of a trace with its mean taken off."""
    return _changes(spark, sf).select("track", "idx", "rms", "snr", F.col("hit").alias("change"))


@query("win28_change_health", CHANGES + """, r AS (SELECT p.track, snr, hit, row_number() OVER (PARTITION BY p.track ORDER BY snr, p.idx) - 1 AS k, count(*) OVER (PARTITION BY p.track) AS n FROM points p JOIN c ON c.track = p.track AND c.idx = p.idx),
  t AS (SELECT track, avg(snr) FILTER (k >= n // 10 AND k < n - n // 10) AS snr, avg(CAST(hit AS DOUBLE)) AS rate FROM r GROUP BY track) SELECT track, CAST(floor(100 * (0.75 * greatest(0.0, least(1.0, (snr + 20) / 60)) + 0.25 * (1 - least(1.0, rate / 0.05))) + 0.5 + 1e-9) AS BIGINT) AS health FROM t""".replace(", r AS", " , r AS"))
def change_health(spark, sf):
    """Three quarters for the trimmed mean ratio, one for few changes."""
    w = Window.partitionBy("track")
    r = _changes(spark, sf).withColumns({"k": F.row_number().over(w.orderBy("snr", "idx")) - 1, "n": F.count("*").over(w)})
    inner = (F.col("k") >= F.expr("n div 10")) & (F.col("k") < F.col("n") - F.expr("n div 10"))
    t = r.groupBy("track").agg(F.avg(F.when(inner, F.col("snr"))).alias("snr"), F.avg(F.col("hit").cast("double")).alias("rate"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    score = unit((F.col("snr") + 20) / 60) * 0.75 + (1 - unit(F.col("rate") / 0.05)) * 0.25
    return t.select("track", F.floor(score * 100 + 0.5 + 1e-9).cast("long").alias("health"))


@query("win30_amplitude_dropouts", f"""WITH {SAMPLES}, c AS (SELECT trace, idx, abs(amp) < 0.05 AS low FROM samples), g AS (SELECT trace, idx, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS grp FROM c WHERE low), r AS (SELECT trace, min(idx) AS a, max(idx) AS b FROM g GROUP BY trace, grp HAVING count(*) >= 2)
  SELECT DISTINCT trace, p AS point FROM r, unnest(range((a + 3) // 4, b // 4 + 1)) AS u(p)""")
def amplitude_dropouts(spark, sf):
    """Envelope points (every fourth sample) that lie in a run of two or more low samples."""
    from ..operators import windows as win

    r = win.runs(samples(spark, sf), ["trace"], "idx", F.abs("amp") < 0.05).where("run_label AND length >= 2")
    lo, hi = F.expr("(first + 3) div 4"), F.expr("last div 4")
    return r.where(lo <= hi).select("trace", F.explode(F.sequence(lo, hi)).alias("point"))


CUTS = f"""{FLUX}, f AS (SELECT track, idx, CAST(round(amp * 1000) AS BIGINT) AS v, sum(CASE WHEN label = 'error' AND idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY idx) AS cut FROM flux),
  g AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY cut) - 1 AS idx, min(f.idx) AS first, max(f.idx) AS last, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM f GROUP BY track, cut),
  cuts AS (SELECT *, coalesce(lead(n) OVER (PARTITION BY track ORDER BY idx), 0) AS nn, coalesce(lead(s) OVER (PARTITION BY track ORDER BY idx), 0) AS ns FROM g)"""
SHORT = recurrence(CUTS, "cuts", "n AS vn, p.s AS vs, p.nn, p.ns", "CAST(0 AS BIGINT) AS ln, CAST(0 AS BIGINT) AS ls, CAST(0 AS BIGINT) AS hn, CAST(0 AS BIGINT) AS hs, 0 AS kind",
                   ["hn + vn AS cn, hs + vs AS cs", "CASE WHEN cn >= 4 THEN 0 WHEN ln > 0 AND (nn = 0 OR abs(cs / cn - ls / greatest(ln, 1)) <= abs(cs / cn - ns / greatest(nn, 1))) THEN 1 WHEN nn > 0 THEN 2 ELSE 0 END AS k",
                    "CASE k WHEN 0 THEN cn WHEN 1 THEN ln + cn ELSE ln END, CASE k WHEN 0 THEN cs WHEN 1 THEN ls + cs ELSE ls END, CASE k WHEN 2 THEN cn ELSE 0 END, CASE k WHEN 2 THEN cs ELSE 0 END, k"],
                   """, k AS (SELECT q.*, c.kind, lag(c.kind) OVER (PARTITION BY q.track ORDER BY q.idx) AS was, first_value(CASE WHEN c.kind < 2 THEN c.kind END IGNORE NULLS) OVER (PARTITION BY q.track ORDER BY q.idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fate FROM cuts q JOIN c ON c.track = q.track AND c.idx = q.idx),
  m AS (SELECT *, sum(CASE WHEN coalesce(was, 0) < 2 AND fate = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY idx) AS seg FROM k) SELECT track, CAST(seg AS BIGINT) AS seg, min(first) AS first, max(last) AS last, round(sum(s) / sum(n) / 1000, 6) AS level FROM m GROUP BY track, seg""")


@query("win31_merge_segments", SHORT)
def merge_segments(spark, sf):
    """Segments cut at changes; those of fewer than four points join the neighbour of nearer level, from left to right."""
    w = Window.partitionBy("track").orderBy("idx")
    f = flux(spark, sf).select("track", "idx", F.round(F.col("amp") * 1000).cast("long").alias("v"), F.sum(F.when((F.col("label") == "error") & (F.col("idx") > 0), 1).otherwise(0)).over(w).alias("cut"))
    g = f.groupBy("track", "cut").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"), F.sum("v").alias("s"))
    g = g.withColumn("idx", (F.row_number().over(Window.partitionBy("track").orderBy("cut")) - 1).cast("long"))
    cuts = g.withColumns({"nn": F.coalesce(F.lead("n").over(w), F.lit(0)), "ns": F.coalesce(F.lead("s").over(w), F.lit(0))})
    kinds = lanes.scan(cuts, "track", "idx", ["n", "s", "nn", "ns"], *lanes.short_loop(4), "kind long")
    k = cuts.join(kinds, ["track", "idx"])
    fate = F.first(F.when(F.col("kind") < 2, F.col("kind")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    k = k.withColumn("starts", (F.coalesce(F.lag("kind").over(w), F.lit(0)) < 2) & (fate == 0))
    m = k.withColumn("seg", F.sum(F.col("starts").cast("long")).over(w))
    return m.groupBy("track", "seg").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.round(F.sum("s") / F.sum("n") / 1000, 6).alias("level"))
