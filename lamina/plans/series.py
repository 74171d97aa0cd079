"""Ordered series: ladders, merges, masks, templates, shifts, spacing. Traces are the embeddings' samples, tracks the events' pulses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import octets
from ..operators import lanes
from ..operators import windows as win
from ..sources.carriers import PULSES, SAMPLES, SECTORS, pulses, samples, sectors, table
from .base import query
from .loops import PHASE


def _w(part="trace"):
    return Window.partitionBy(part).orderBy("idx")


#: Three scales of level and the best ratio over them, the shape around each sample.
SCALES = f"""{SAMPLES}, d AS (SELECT *, amp - lag(amp) OVER w AS delta, lead(amp) OVER w - amp AS after FROM samples WINDOW w AS (PARTITION BY trace ORDER BY idx)), m AS (SELECT trace, 1.4826 * median(abs(coalesce(delta, 0))) AS sigma FROM d GROUP BY trace),
  e AS (SELECT d.trace, idx, coalesce(delta, 0) AS delta, after, sigma, round(sqrt(avg(delta * delta) OVER a), 9) AS r0, round(sqrt(avg(delta * delta) OVER b), 9) AS r1, round(sqrt(avg(delta * delta) OVER c), 9) AS r2 FROM d JOIN m USING (trace)
  WINDOW a AS (PARTITION BY d.trace ORDER BY idx ROWS 1 PRECEDING), b AS (PARTITION BY d.trace ORDER BY idx ROWS 3 PRECEDING), c AS (PARTITION BY d.trace ORDER BY idx ROWS 7 PRECEDING)),
  f AS (SELECT trace, idx, delta, greatest(coalesce(r0, 0), coalesce(r1, 0), coalesce(r2, 0)) AS top, CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS scale, sigma, delta * after < 0 AND abs(after) > abs(delta) * 0.8 AS swings FROM e),
  g AS (SELECT *, round(CASE WHEN top > 0 AND sigma > 0 THEN 20 * log10(top / sigma) ELSE -60.0 END, 6) AS snr FROM f),
  ladder AS (SELECT trace, idx, snr, CASE WHEN top < 0.001 THEN 'NONE' WHEN coalesce(swings, false) AND snr >= 5 THEN 'OSCILLATION' WHEN delta > 0 AND snr >= 3 THEN 'REFLECTION' WHEN delta < 0 AND snr >= 2 THEN CASE WHEN scale >= 2 AND snr < 8 THEN 'BROADLOSS' ELSE 'ATTENUATION' END ELSE 'NONE' END AS kind FROM g)"""


def _ladder(spark, sf):
    d = samples(spark, sf).withColumns({"delta": F.col("amp") - F.lag("amp").over(_w()), "after": F.lead("amp").over(_w()) - F.col("amp")})
    rms = lambda n: F.round(F.sqrt(F.avg(F.col("delta") * F.col("delta")).over(_w().rowsBetween(-n, 0))), 9)
    e = d.withColumns({"sigma": F.median(F.abs(F.coalesce("delta", F.lit(0.0)))).over(Window.partitionBy("trace")) * 1.4826, "r0": rms(1), "r1": rms(3), "r2": rms(7)})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scale = F.when((F.col("r0") >= F.col("r1")) & (F.col("r0") >= F.col("r2")), 0).when(F.col("r1") >= F.col("r2"), 1).otherwise(2)
    f = e.select("trace", "idx", zero("delta").alias("delta"), "after", "sigma", F.greatest(zero("r0"), zero("r1"), zero("r2")).alias("top"), scale.alias("scale"))
    snr = F.round(F.when((F.col("top") > 0) & (F.col("sigma") > 0), F.log10(F.col("top") / F.nullif("sigma", F.lit(0.0))) * 20).otherwise(-60.0), 6)
    g = f.withColumns({"snr": snr, "swings": F.coalesce((F.col("delta") * F.col("after") < 0) & (F.abs("after") > F.abs("delta") * 0.8), F.lit(False))})
    s = F.col("snr")
    kind = (F.when(F.col("top") < 0.001, "NONE").when(F.col("swings") & (s >= 5), "OSCILLATION").when((F.col("delta") > 0) & (s >= 3), "REFLECTION")
            .when((F.col("delta") < 0) & (s >= 2), F.when((F.col("scale") >= 2) & (s < 8), "BROADLOSS").otherwise("ATTENUATION")).otherwise("NONE"))
    return g.select("trace", "idx", "snr", "delta", kind.alias("kind"))


@query("win05_ladder", f"WITH {SCALES} SELECT trace, idx, kind, round(CASE kind WHEN 'OSCILLATION' THEN least(1.0, (snr - 5) / 20) WHEN 'REFLECTION' THEN least(1.0, (snr - 3) / 20) WHEN 'BROADLOSS' THEN least(1.0, greatest(0.0, (snr - 4) / 20)) WHEN 'ATTENUATION' THEN least(1.0, (snr - 2) / 20) ELSE 0.0 END, 8) AS confidence FROM ladder")
def ladder(spark, sf):
    """Ordered tests on shape, direction and signal-to-noise ratio over three scales."""
    base = F.create_map(*[F.lit(x) for x in ("OSCILLATION", 5.0, "REFLECTION", 3.0, "BROADLOSS", 4.0, "ATTENUATION", 2.0)])
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("snr") - F.try_element_at(base, F.col("kind"))) / 20))
    return _ladder(spark, sf).select("trace", "idx", "kind", F.round(F.when(F.col("kind") == "NONE", 0.0).otherwise(conf), 8).alias("confidence"))


#: Rules in order: first label, second label, samples at least of each, samples of NONE between them at most, what they become.
_RULES = [("REFLECTION", "ATTENUATION", 1, 1, 2, "REFLECT_LOSS"), ("ATTENUATION", "ATTENUATION", 1, 1, 1, "ATTENUATION"), ("OSCILLATION", "OSCILLATION", 1, 1, 3, "OSCILLATION"), ("BROADLOSS", "ATTENUATION", 1, 1, 2, "BROADLOSS")]


def _merge_once(segs):
    """One pass from left to right over a trace's segments (label, first, last): the first rule that fits joins a segment with the next one that is
    not NONE, if no more than the rule's gap lies between. A trace's segments are one array; the pass is a fold over it."""
    zero = F.struct(F.lit(0).alias("skip"), F.array().cast("array<struct<label: string, first: long, last: long>>").alias("out"))

    def step(acc, i):
        a = F.get(segs, i)
        one, two = F.get(segs, i + 1), F.get(segs, i + 2)
        via = one["label"] == "NONE"
        b = F.when(via, two).otherwise(one)
        gap = F.when(via, one["last"] - one["first"] + 1).otherwise(0)
        size = lambda x: x["last"] - x["first"] + 1
        made = None
        for x, y, na, nb, most, name in _RULES:
            test = (a["label"] == x) & (b["label"] == y) & (size(a) >= na) & (size(b) >= nb) & (gap <= most)
            made = F.when(test, F.lit(name)) if made is None else made.when(test, F.lit(name))
        joined = F.struct(made.alias("label"), a["first"].alias("first"), b["last"].alias("last"))
        plain = F.struct(a["label"].alias("label"), a["first"].alias("first"), a["last"].alias("last"))
        fits = made.isNotNull()
        return F.when(acc["skip"] > 0, F.struct((acc["skip"] - 1).alias("skip"), acc["out"].alias("out"))).otherwise(
            F.struct(F.when(fits, F.when(via, 2).otherwise(1)).otherwise(0).alias("skip"), F.concat(acc["out"], F.array(F.when(fits, joined).otherwise(plain))).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(segs) - 1), zero, step)["out"]


def _merged(segs, passes: int):
    for _ in range(passes):
        segs = octets.once(segs, _merge_once)
    return segs


def _pass_sql(n: int, src: str) -> str:
    """One greedy pass in SQL: what each segment could join with, then the chain of taken segments by recursion."""
    return f"""n{n} AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY first) AS k FROM {src}),
  o{n} AS (SELECT a.trace, a.k, a.label, a.first, a.last, CASE WHEN o.label = 'NONE' THEN t.label ELSE o.label END AS bl, CASE WHEN o.label = 'NONE' THEN t.last ELSE o.last END AS blast, CASE WHEN o.label = 'NONE' THEN o.last - o.first + 1 ELSE 0 END AS gap, CASE WHEN o.label = 'NONE' THEN 2 ELSE 1 END AS used
    FROM n{n} a LEFT JOIN n{n} o ON o.trace = a.trace AND o.k = a.k + 1 LEFT JOIN n{n} t ON t.trace = a.trace AND t.k = a.k + 2),
  j{n} AS (SELECT *, CASE {' '.join(f"WHEN label = '{x}' AND bl = '{y}' AND gap <= {most} THEN '{name}'" for x, y, _, _, most, name in _RULES)} END AS made FROM o{n}),
  c{n} AS (SELECT trace, k, label, first, last, blast, made, k + 1 + CASE WHEN made IS NULL THEN 0 ELSE used END AS nxt FROM j{n} WHERE k = 1 UNION ALL SELECT j.trace, j.k, j.label, j.first, j.last, j.blast, j.made, j.k + 1 + CASE WHEN j.made IS NULL THEN 0 ELSE j.used END FROM c{n} c JOIN j{n} j ON j.trace = c.trace AND j.k = c.nxt),
  s{n} AS (SELECT trace, coalesce(made, label) AS label, first, CASE WHEN made IS NULL THEN last ELSE blast END AS last FROM c{n})"""


_RAW = "q0 AS (SELECT *, idx - row_number() OVER (PARTITION BY trace, kind ORDER BY idx) AS grp FROM ladder), s0 AS (SELECT trace, kind AS label, min(idx) AS first, max(idx) AS last FROM q0 GROUP BY trace, kind, grp)"


def _segments(spark, sf):
    r = win.runs(_ladder(spark, sf), ["trace"], "idx", F.col("kind"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("first", F.col("run_label").alias("label"), "last"))), lambda s: F.struct(s["label"].alias("label"), s["first"].alias("first"), s["last"].alias("last")))
    return r.groupBy("trace").agg(each.alias("segs"))  # a trace's segments


def _rows(arrays):
    return arrays.select("trace", F.explode("segs").alias("s")).select("trace", "s.label", "s.first", "s.last")


@query("win09_merge_pass", f"WITH RECURSIVE {SCALES}, {_RAW}, {_pass_sql(1, 's0')} SELECT trace, label, first, last FROM s1")
def merge_pass(spark, sf):
    return _rows(_segments(spark, sf).withColumn("segs", _merged(F.col("segs"), 1)))


@query("win08_rule_merge", f"WITH RECURSIVE {SCALES}, {_RAW}, " + ", ".join(_pass_sql(n, f"s{n - 1}") for n in range(1, 9)) + " SELECT trace, label, first, last FROM s8")
def rule_merge(spark, sf):
    """Four rules, eight passes at most; a pass over what is settled changes nothing."""
    return _rows(_segments(spark, sf).withColumn("segs", _merged(F.col("segs"), 8)))


@query("win10_pass_fail", f"""WITH {SCALES}, {_RAW}, p AS (SELECT s.trace, label, first, max(last) AS last, max(abs(g.delta)) AS loss, max(g.snr) AS snr FROM s0 s JOIN g ON g.trace = s.trace AND g.idx BETWEEN s.first AND s.last GROUP BY s.trace, label, first),
  r AS (SELECT *, CASE WHEN label = 'NONE' THEN 0 ELSE CASE WHEN loss > 0.3 THEN 1 ELSE 0 END + CASE WHEN snr < 4 THEN 2 ELSE 0 END + CASE WHEN last - first + 1 > 5 THEN 4 ELSE 0 END + CASE WHEN label = 'REFLECTION' AND snr > 9 THEN 8 ELSE 0 END END AS reasons,
  label <> 'NONE' AND ((loss <= 0.3 AND loss > 0.3 * 0.7) OR (snr >= 4 AND snr < 4 / 0.7)) AS near FROM p) SELECT trace, first, label, reasons, CASE WHEN reasons > 0 THEN 'FAIL' WHEN near THEN 'WARN' ELSE 'PASS' END AS verdict FROM r""")
def pass_fail(spark, sf):
    """Limits on loss, ratio, length and reflection as a mask of reasons; close to a limit is a warning."""
    l = _ladder(spark, sf)
    r = win.runs(l, ["trace"], "idx", F.col("kind"), F.max(F.abs("delta")).alias("loss"), F.max("snr").alias("snr")).withColumnRenamed("run_label", "label")
    bit = lambda test, n: F.when(test, n).otherwise(0)
    loss, snr, real = F.col("loss"), F.col("snr"), F.col("label") != "NONE"
    mask = bit(loss > 0.3, 1) + bit(snr < 4, 2) + bit(F.col("length") > 5, 4) + bit((F.col("label") == "REFLECTION") & (snr > 9), 8)
    near = real & (((loss <= 0.3) & (loss > 0.3 * 0.7)) | ((snr >= 4) & (snr < 4 / 0.7)))
    out = r.select("trace", "first", "label", F.when(real, mask).otherwise(0).alias("reasons"), near.alias("near"))
    return out.select("trace", "first", "label", "reasons", F.when(F.col("reasons") > 0, "FAIL").when(F.col("near"), "WARN").otherwise("PASS").alias("verdict"))


#: Flags in the order in which they are given: dropout and clipping first, stuck runs only where no member has one, dead zones on what is left.
FLAGS = f"""{SAMPLES}, a AS (SELECT *, abs(amp) < 0.03 AS low, abs(amp) >= 0.2 AS high, abs(amp - lag(amp) OVER w) AS step FROM samples WINDOW w AS (PARTITION BY trace ORDER BY idx)), st AS (SELECT *, coalesce(step <= 0.02, false) AS still FROM a),
  sg AS (SELECT *, idx - row_number() OVER (PARTITION BY trace, still ORDER BY idx) AS grp FROM st), sr AS (SELECT trace, min(idx) - 1 AS first, max(idx) AS last FROM sg WHERE still GROUP BY trace, grp HAVING count(*) >= 2),
  sk AS (SELECT r.trace, r.first, r.last FROM sr r JOIN a ON a.trace = r.trace AND a.idx BETWEEN r.first AND r.last GROUP BY 1, 2, 3 HAVING NOT bool_or(low OR high))"""


def _flags(spark, sf):
    a = samples(spark, sf).withColumns({"low": F.abs("amp") < 0.03, "high": F.abs("amp") >= 0.2, "step": F.abs(F.col("amp") - F.lag("amp").over(_w()))})
    st = a.withColumn("still", F.coalesce(F.col("step") <= 0.02, F.lit(False))).withColumn("bad", F.col("low") | F.col("high"))
    st = st.withColumn("before_bad", F.lag("bad").over(_w()))
    # The run's first row compares with the sample before it, which belongs to the run.
    r = win.runs(st, ["trace"], "idx", F.col("still"), F.bool_or("bad").alias("bad"), F.min_by("before_bad", "idx").alias("first_bad"))
    stuck = r.where("run_label AND length >= 2 AND NOT bad AND NOT first_bad").select("trace", (F.col("first") - 1).alias("first"), "last")
    return st, stuck


@query("win13_stuck_runs", f"WITH {FLAGS} SELECT trace, first, last, last - first + 1 AS length FROM sk")
def stuck_runs(spark, sf):
    """Runs that hardly move, with the sample before them; a run with a dropout or a clipped sample is left to those."""
    return _flags(spark, sf)[1].withColumn("length", F.col("last") - F.col("first") + 1)


@query("win14_dead_zone", f"""WITH {FLAGS}, sig AS (SELECT trace, idx // 16 AS blk, 1.4826 * median(step) AS sigma FROM a WHERE step IS NOT NULL GROUP BY 1, 2), z AS (SELECT a.trace, a.idx, step > 0 AND sigma > 0 AND NOT low AND NOT high AND NOT EXISTS (SELECT 1 FROM sk WHERE sk.trace = a.trace AND a.idx BETWEEN sk.first AND sk.last) AND round(20 * log10(step / sigma), 6) < 3 AS quiet FROM a JOIN sig ON sig.trace = a.trace AND sig.blk = a.idx // 16),
  zg AS (SELECT trace, idx, idx - row_number() OVER (PARTITION BY trace ORDER BY idx) AS grp FROM z WHERE quiet) SELECT trace, min(idx) AS first, max(idx) AS last, count(*) AS length FROM zg GROUP BY trace, grp HAVING count(*) >= 4""".replace("round(20 * log10(step / sigma), 6) < 3", "CASE WHEN step > 0 AND sigma > 0 THEN round(20 * log10(step / sigma), 6) < 3 ELSE false END"))
def dead_zone(spark, sf):
    """Unflagged runs of steps below 3 dB over a deviation that is taken anew every sixteen samples."""
    st, stuck = _flags(spark, sf)
    sigma = F.median("step").over(Window.partitionBy("trace", F.expr("idx div 16"))) * 1.4826
    held = stuck.select("trace", F.explode(F.sequence("first", "last")).alias("idx"), F.lit(True).alias("held"))
    z = st.withColumn("sigma", sigma).join(held, ["trace", "idx"], "left").where("held IS NULL AND NOT low AND NOT high AND step > 0 AND sigma > 0")
    q = z.where(F.round(F.log10(F.col("step") / F.col("sigma")) * 20, 6) < 3)
    g = q.withColumn("grp", F.col("idx") - F.row_number().over(_w()))
    return g.groupBy("trace", "grp").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("length")).where("length >= 4").drop("grp")


@query("win16_confidence_map", f"""WITH {SECTORS}, v AS (SELECT track, sector, read, CAST(count(*) OVER (PARTITION BY track, sector, data) AS DOUBLE) / count(*) OVER (PARTITION BY track, sector) AS agree, least(1.0, quality / 50) AS snr, CASE WHEN NOT crc_ok THEN 0.0 WHEN weak OR deleted THEN 0.5 ELSE 1.0 END AS integ FROM sectors)
  SELECT track, sector, read, round(least(1.0, greatest(0.0, (8 * agree + 7 * snr + 5 * integ) / 20)), 6) AS confidence FROM v""")
def confidence_map(spark, sf):
    """Agreement between reads, normalised ratio and integrity by weights 0.40, 0.35 and 0.25 over their sum."""
    w = Window.partitionBy("track", "sector")
    agree = F.count("*").over(Window.partitionBy("track", "sector", "data")) / F.count("*").over(w)
    integ = F.when(~F.col("crc_ok"), 0.0).when(F.col("weak") | F.col("deleted"), 0.5).otherwise(1.0)
    weights = (8, 7, 5)
    x = sum((c * k for c, k in zip((agree, F.least(F.lit(1.0), F.col("quality") / 50), integ), weights, strict=True)), F.lit(0.0)) / sum(weights)
    return sectors(spark, sf).select("track", "sector", "read", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6).alias("confidence"))


PROFILE = PHASE.replace("SELECT track, idx, n AS cells, round(period, 6) AS period FROM c WHERE idx >= 0", ", q AS (SELECT c.track, c.idx, n AS cells, dt, abs(dt - n * period) / (n * period) * 100 AS dev FROM c JOIN pulses p ON p.track = c.track AND p.idx = c.idx WHERE c.idx >= 0)") + """
  SELECT track, idx, cells, round(-20 * log10(1 + dev / 10), 4) AS db, round(sqrt(avg(dev * dev) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)), 4) AS jitter FROM q"""


def _quality(spark, sf):
    start, step = lanes.phase_loop(2000.0, 0.5, 0.05)
    p = pulses(spark, sf)
    loop = lanes.scan(p, "track", "idx", ["dt"], start, step, "cells long, period double")
    want = F.col("cells") * F.col("period")
    return p.join(loop, ["track", "idx"]).withColumn("dev", F.abs(F.col("dt") - want) / want * 100)


@query("win18_quality_profile", PROFILE)
def quality_profile(spark, sf):
    """Deviation from the loop's cells in decibels, and its level over the eight around each interval."""
    q = _quality(spark, sf)
    jitter = F.sqrt(F.avg(F.col("dev") * F.col("dev")).over(_w("track").rowsBetween(-4, 3)))
    return q.select("track", "idx", "cells", F.round(F.log10(F.col("dev") / 10 + 1) * -20, 4).alias("db"), F.round(jitter, 4).alias("jitter"))


EVENTS = PROFILE[: PROFILE.index("\n  SELECT track, idx, cells, round(-20")] + """, x AS (SELECT *, round(sqrt(avg(dev * dev) OVER (PARTITION BY track ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)), 6) AS jit, round(dev, 6) AS dv FROM q), y AS (SELECT *, lag(jit) OVER w AS pj, lag(dv) OVER w AS pd FROM x WINDOW w AS (PARTITION BY track ORDER BY idx)),
  dg AS (SELECT track, idx, idx - row_number() OVER (PARTITION BY track ORDER BY idx) AS grp FROM y WHERE dv > 2), tl AS (SELECT track, sum(dt) AS ns, avg(sum(dt)) OVER () AS expect FROM q GROUP BY track)
  SELECT track, idx, 'NOFLUX' AS kind FROM y WHERE dt > 8100 UNION ALL SELECT track, idx, 'JITTER_SPIKE' FROM y WHERE idx > 0 AND jit > 3 AND jit > pj * 1.5 UNION ALL SELECT track, min(idx), 'DRIFT' FROM dg GROUP BY track, grp HAVING count(*) > 4 UNION ALL SELECT track, idx, 'PLL_RELOCK' FROM y WHERE idx > 16 AND dv < 1 AND pd >= 1
  UNION ALL SELECT track, idx, 'ENCODING_ERROR' FROM y WHERE dt <= 8100 AND dt < 3850 UNION ALL SELECT track, 0, CASE WHEN ns > expect THEN 'LONG_TRACK' ELSE 'SHORT_TRACK' END FROM tl WHERE abs(ns - expect) / expect > 0.02"""


@query("win20_events", EVENTS)
def events(spark, sf):
    """All kinds of events: gaps, jitter spikes, drifts, locks regained, intervals of no code, tracks longer or shorter than the rest by a fiftieth."""
    w = _w("track")
    q = _quality(spark, sf).withColumns({"jit": F.round(F.sqrt(F.avg(F.col("dev") * F.col("dev")).over(w.rowsBetween(-4, 3))), 6), "dv": F.round("dev", 6)})
    y = q.withColumns({"pj": F.lag("jit").over(w), "pd": F.lag("dv").over(w)})
    kind = lambda test, name: F.when(test, F.lit(name))
    each = F.array_compact(F.array(kind(F.col("dt") > 8100, "NOFLUX"), kind((F.col("idx") > 0) & (F.col("jit") > 3) & (F.col("jit") > F.col("pj") * 1.5), "JITTER_SPIKE"),
                                   kind((F.col("idx") > 16) & (F.col("dv") < 1) & (F.col("pd") >= 1), "PLL_RELOCK"), kind(F.col("dt") < 3850, "ENCODING_ERROR")))
    at = y.select("track", "idx", F.explode(each).alias("kind"))
    drift = win.runs(y, ["track"], "idx", F.col("dv") > 2).where("run_label AND length > 4").select("track", F.col("first").alias("idx"), F.lit("DRIFT").alias("kind"))
    length = pulses(spark, sf).groupBy("track").agg(F.sum("dt").alias("ns"))
    both = length.crossJoin(F.broadcast(length.agg(F.avg("ns").alias("expect"))))  # one row
    odd = both.where(F.abs(F.col("ns") - F.col("expect")) / F.col("expect") > 0.02).select("track", F.lit(0).cast("long").alias("idx"), F.when(F.col("ns") > F.col("expect"), "LONG_TRACK").otherwise("SHORT_TRACK").alias("kind"))
    return at.unionByName(drift).unionByName(odd)


REVS = f"{PULSES}, revs AS (SELECT track // 5 AS disk, track % 5 AS rev, idx, dt FROM pulses)"


@query("win21_weak_bits", f"""WITH {REVS}, c AS (SELECT disk, idx, coalesce(stddev_pop(dt) / avg(dt) > 0.25, false) OR count(DISTINCT CASE WHEN dt < 5000 THEN 2 WHEN dt < 7000 THEN 3 ELSE 4 END) > 2 AS weak FROM revs GROUP BY disk, idx HAVING count(*) > 1),
  g AS (SELECT disk, idx, idx - row_number() OVER (PARTITION BY disk ORDER BY idx) AS grp FROM c WHERE weak) SELECT disk, min(idx) AS first, count(*) AS length, count(*) > 8 AND count(*) < 128 AS fuzzy FROM g GROUP BY disk, grp HAVING count(*) >= 2""")
def weak_bits(spark, sf):
    """Places where revolutions disagree in spread or in class, as regions; those of middle length look fuzzy on purpose."""
    r = pulses(spark, sf).select(F.expr("track div 5").alias("disk"), "idx", "dt")
    kind = F.when(F.col("dt") < 5000, 2).when(F.col("dt") < 7000, 3).otherwise(4)
    c = r.groupBy("disk", "idx").agg(F.count("*").alias("n"), (F.coalesce(F.stddev_pop("dt") / F.avg("dt") > 0.25, F.lit(False)) | (F.count_distinct(kind) > 2)).alias("weak")).where("n > 1 AND weak")
    g = c.withColumn("grp", F.col("idx") - F.row_number().over(_w("disk")))
    return g.groupBy("disk", "grp").agg(F.min("idx").alias("first"), F.count("*").alias("length")).where("length >= 2").select("disk", "first", "length", ((F.col("length") > 8) & (F.col("length") < 128)).alias("fuzzy"))


TEMPLATE = [0.1, -0.1, 0.1, -0.1]
_DOT = " + ".join(f"coalesce(lead(amp, {i}) OVER w, 0) * {t}" for i, t in enumerate(TEMPLATE))
_NORM = " + ".join(f"pow(coalesce(lead(amp, {i}) OVER w, 0), 2)" for i in range(len(TEMPLATE)))


@query("win22_template", f"""WITH RECURSIVE {SAMPLES}, s AS (SELECT trace, idx, round(({_DOT}) / (sqrt({_NORM}) * {sum(t * t for t in TEMPLATE) ** 0.5}), 6) AS score, lead(amp, 3) OVER w IS NOT NULL AS whole FROM samples WINDOW w AS (PARTITION BY trace ORDER BY idx)), h AS (SELECT trace, idx, score FROM s WHERE whole AND score >= 0.6),
  t AS (SELECT trace, min(idx) AS idx FROM h GROUP BY trace UNION ALL SELECT t.trace, (SELECT min(h.idx) FROM h WHERE h.trace = t.trace AND h.idx >= t.idx + 4) FROM t WHERE EXISTS (SELECT 1 FROM h WHERE h.trace = t.trace AND h.idx >= t.idx + 4)) SELECT t.trace, t.idx, h.score FROM t JOIN h ON h.trace = t.trace AND h.idx = t.idx""")
def template(spark, sf):
    """Places where a template fits, from the left, none within a template's length of the one before."""
    lead = [F.lead("amp", i).over(_w()) for i in range(len(TEMPLATE))]
    s = samples(spark, sf).withColumn("v", F.array(*lead)).where(F.get("v", F.lit(len(TEMPLATE) - 1)).isNotNull())
    dot = sum((F.get("v", F.lit(i)) * t for i, t in enumerate(TEMPLATE)), F.lit(0.0))
    norm = F.sqrt(sum((F.get("v", F.lit(i)) * F.get("v", F.lit(i)) for i in range(len(TEMPLATE))), F.lit(0.0))) * sum(t * t for t in TEMPLATE) ** 0.5
    h = s.withColumn("score", F.round(dot / F.nullif(norm, F.lit(0.0)), 6)).where("score >= 0.6").groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("idx", "score"))).alias("h"))  # a trace's hits
    kind = "struct<idx: long, score: double>"
    taken = F.aggregate("h", F.array().cast(f"array<{kind}>"), lambda acc, x: F.when((F.size(acc) == 0) | (x["idx"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["idx"], F.lit(-9)) + len(TEMPLATE)), F.concat(acc, F.array(x))).otherwise(acc))
    return h.select("trace", F.explode(taken).alias("x")).select("trace", "x.*")


@query("win29_low_envelope", f"""WITH {SAMPLES}, e AS (SELECT trace, idx // 4 AS point, sqrt(avg(amp * amp) OVER (PARTITION BY trace ORDER BY idx ROWS 7 PRECEDING)) AS rms, idx FROM samples), p AS (SELECT trace, point, rms FROM e WHERE idx % 4 = 0), t AS (SELECT trace, 0.9 * median(rms) AS lim FROM p GROUP BY trace),
  l AS (SELECT p.trace, point, point - row_number() OVER (PARTITION BY p.trace ORDER BY point) AS grp FROM p JOIN t ON t.trace = p.trace WHERE round(rms, 9) < round(lim, 9)) SELECT trace, min(point) AS first, max(point) AS last, count(*) AS length FROM l GROUP BY trace, grp HAVING count(*) >= 2""")
def low_envelope(spark, sf):
    """Runs of envelope points below nine tenths of the trace's median level."""
    e = samples(spark, sf).withColumn("rms", F.round(win.rms(F.col("amp"), win.trailing(["trace"], "idx", 8)), 9)).where("idx % 4 = 0").withColumn("point", F.expr("idx div 4"))
    lim = F.round(F.median(F.col("rms")).over(Window.partitionBy("trace")) * 0.9, 9)
    l = e.withColumn("lim", lim).where("rms < lim").withColumn("grp", F.col("point") - F.row_number().over(Window.partitionBy("trace").orderBy("point")))
    return l.groupBy("trace", "grp").agg(F.min("point").alias("first"), F.max("point").alias("last"), F.count("*").alias("length")).where("length >= 2").drop("grp")


@query("win35_aligned_traces", f"""WITH {SAMPLES}, ref AS (SELECT label, min(trace) AS r FROM samples GROUP BY label), d AS (SELECT x.trace, l.lag, sum(y.amp * x.amp) AS dot FROM samples x JOIN ref ON ref.label = x.label, range(-4, 5) AS l(lag), samples y WHERE y.trace = ref.r AND y.idx = x.idx - l.lag GROUP BY 1, 2), b AS (SELECT trace, arg_max(lag, (round(dot, 9), -lag)) AS shift FROM d GROUP BY trace)
  SELECT s.trace, s.idx, round(coalesce(z.amp, 0), 6) AS aligned FROM samples s JOIN b ON b.trace = s.trace LEFT JOIN samples z ON z.trace = s.trace AND z.idx = s.idx + b.shift""")
def aligned_traces(spark, sf):
    """Each trace shifted to where it fits its class's first trace best; what moves in from outside is zero."""
    s = samples(spark, sf)
    series = F.transform(F.array_sort(F.collect_list(F.struct("idx", "amp"))), lambda x: x["amp"])
    by = s.groupBy("trace", "label").agg(series.alias("v"))
    ref = by.groupBy("label").agg(F.min_by("v", "trace").alias("r"))  # a row a class

    def dot(lag):
        return F.aggregate(F.sequence(F.lit(0), F.size("v") - 1), F.lit(0.0), lambda a, i: a + F.get("v", i) * F.coalesce(F.when(i - lag >= 0, F.get("r", i - lag)), F.lit(0.0)))

    lags = F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda lag: F.struct(F.round(dot(lag), 9).alias("dot"), (-lag).alias("lag")))
    b = by.join(F.broadcast(ref), "label").withColumn("shift", -F.array_max(lags)["lag"])
    moved = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: F.coalesce(F.when(i + F.col("shift") >= 0, F.get("v", i + F.col("shift"))), F.lit(0.0)))
    return b.select("trace", F.posexplode(moved).alias("idx", "amp")).select("trace", F.col("idx").cast("long").alias("idx"), F.round("amp", 6).alias("aligned"))


@query("win41_llr", f"""WITH {PULSES}, p AS (SELECT track, idx, dt, greatest(1, CAST(floor(dt / 2000.0 + 0.5) AS BIGINT)) AS n FROM pulses), e AS (SELECT track, idx, n, dt - n * 2000 AS err, greatest(50.0, stddev_pop(dt - n * 2000) OVER (PARTITION BY track)) AS sigma FROM p)
  SELECT track, idx, k AS cell, CASE WHEN k = n THEN 1 ELSE 0 END AS bit, round((CASE WHEN k = n THEN 1 ELSE -1 END) * ((2000 - 2 * abs(err)) * 2000 / (2 * sigma * sigma)), 4) AS llr FROM e, unnest(range(1, n + 1)) AS u(k)""")
def llr(spark, sf):
    """For each cell of an interval the log likelihood ratio of a one: the chance of the interval's timing error against that of the next cell's."""
    n = F.greatest(F.lit(1), F.floor(F.col("dt") / 2000.0 + 0.5))
    e = pulses(spark, sf).withColumn("n", n).withColumn("err", F.col("dt") - F.col("n") * 2000)
    e = e.withColumn("sigma", F.greatest(F.lit(50.0), F.stddev_pop("err").over(Window.partitionBy("track"))))
    c = e.withColumn("cell", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    one = F.col("cell") == F.col("n")
    ratio = (2000 - F.abs("err") * 2) * 2000 / (F.col("sigma") * F.col("sigma") * 2)
    return c.select("track", "idx", "cell", F.when(one, 1).otherwise(0).alias("bit"), F.round(F.when(one, ratio).otherwise(-ratio), 4).alias("llr"))


def _slots(n: int, step: int) -> list[int]:
    """Slot of each sector: from slot 0 on by step, the next free one where a slot is taken."""
    taken, at, out = set(), 0, []
    for _ in range(n):
        while at in taken:
            at = (at + 1) % n
        taken.add(at)
        out.append(at)
        at = (at + step) % n
    return out


def _layouts() -> list[tuple[int, int, list[int], float]]:
    """(sectors, sector size, slots, skew a track) of every number of sectors and the three sizes."""
    out = []
    for n in range(1, 27):
        for size in (128, 256, 512):
            step = (n + 1) // 2 if size == 128 else (n * 15 + 17) // 18 if size == 256 else 1
            out.append((n, size, _slots(n, step), 0.0 if size >= 512 else 0.08))
    return out


@query("win47_interleave", "WITH RECURSIVE p AS (SELECT p_partkey AS disk, CAST(5 + p_size % 20 AS BIGINT) AS n, [128, 256, 512][CAST(1 + p_partkey % 3 AS BIGINT)] AS size, p_partkey % 40 AS track FROM part), q AS (SELECT *, CASE size WHEN 128 THEN (n + 1) // 2 WHEN 256 THEN (n * 15 + 17) // 18 ELSE 1 END AS step, CASE WHEN size = 512 THEN 0.0::DOUBLE ELSE 0.08 * track END AS t0 FROM p), "
       "c AS (SELECT disk, n, step, t0, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS slot, [CAST(0 AS BIGINT)] AS taken FROM q UNION ALL SELECT disk, n, step, t0, i + 1, s, list_append(taken, s) FROM (SELECT *, list_filter([(slot + step + d) % n FOR d IN range(0, n)], lambda x: NOT list_contains(taken, x))[1] AS s FROM c WHERE i + 1 < n)) "
       "SELECT disk, i AS sector, slot, round((t0 + slot * 0.98 / n) % 1.0, 6) AS timing FROM c")
def interleave(spark, sf):
    """Sectors dealt to slots by the interleave of their size, each track skewed against the one before; layouts are a small table."""
    k = F.col("p_partkey")
    size = F.get(F.array(F.lit(128), F.lit(256), F.lit(512)), (k % 3).cast("int"))
    p = table(spark, sf, "part").select(k.alias("disk"), (F.col("p_size") % 20 + 5).alias("n"), size.alias("size"), (k % 40).alias("track"))
    layouts = F.broadcast(spark.createDataFrame(_layouts(), "n int, size int, slots array<int>, skew double"))  # 78 rows
    at = p.join(layouts, ["n", "size"]).select("disk", "n", "track", "skew", F.posexplode("slots").alias("sector", "slot"))
    t = F.col("skew") * F.col("track") + F.col("slot") * 0.98 / F.col("n")
    return at.select("disk", F.col("sector").cast("long").alias("sector"), F.col("slot").cast("long").alias("slot"), F.round(t % 1.0, 6).alias("timing"))


@query("win48_precompensation", f"""WITH {PULSES}, t AS (SELECT track, idx, sum(dt) OVER (PARTITION BY track ORDER BY idx ROWS UNBOUNDED PRECEDING) AS at_ns, dt AS d1, lead(dt) OVER (PARTITION BY track ORDER BY idx) AS d2 FROM pulses)
  SELECT track, idx, CAST(at_ns + CASE WHEN d2 IS NULL OR idx = 0 THEN 0 ELSE greatest(-(d1 // 2), least(d2 // 2, CAST(floor((d2 - d1) * 5 / 12.0) AS BIGINT))) END AS BIGINT) AS written FROM t""")
def precompensation(spark, sf):
    """Transitions moved by 5/12 of the difference of the gaps around them, by half a gap at most, all from the original places."""
    t = pulses(spark, sf).withColumns({"at": F.sum("dt").over(_w("track").rowsBetween(Window.unboundedPreceding, 0)), "d2": F.lead("dt").over(_w("track"))})
    move = F.greatest(-F.expr("dt div 2"), F.least(F.expr("d2 div 2"), F.floor((F.col("d2") - F.col("dt")) * 5 / 12)))
    return t.select("track", "idx", (F.col("at") + F.when(F.col("d2").isNull() | (F.col("idx") == 0), 0).otherwise(move)).cast("long").alias("written"))
