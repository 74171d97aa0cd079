"""Further sequence operators: multi-scale features, pass and fail, templates, envelopes, soft decoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..operators import windows as win
from ..sources.carriers import FLUX, SAMPLES, SECTORS, flux, samples, sectors, table
from .base import query


def _w():
    return Window.partitionBy("trace").orderBy("idx")


@query("win02_multi_scale", f"""WITH {SAMPLES} SELECT trace, idx, round(sqrt(avg(amp * amp) OVER a), 6) AS r4, round(sqrt(avg(amp * amp) OVER b), 6) AS r16, round(sqrt(avg(amp * amp) OVER c), 6) AS r64 FROM samples
  WINDOW a AS (PARTITION BY trace ORDER BY idx ROWS 3 PRECEDING), b AS (PARTITION BY trace ORDER BY idx ROWS 15 PRECEDING), c AS (PARTITION BY trace ORDER BY idx ROWS 63 PRECEDING)""")
def multi_scale(spark, sf):
    return samples(spark, sf).select("trace", "idx", *[F.round(win.rms(F.col("amp"), win.trailing(["trace"], "idx", n)), 6).alias(f"r{n}") for n in (4, 16, 64)])


POLAR = f"""{SAMPLES}, d AS (SELECT trace, idx, coalesce(amp - lag(amp) OVER (PARTITION BY trace ORDER BY idx), 0) AS delta FROM samples),
  s AS (SELECT trace, idx, CASE WHEN delta > 0.15 THEN 1 WHEN delta < -0.15 THEN -1 ELSE 0 END AS sg FROM d),
  n AS (SELECT trace, idx, sg, count(*) FILTER (sg > 0) OVER w AS up, count(*) FILTER (sg < 0) OVER w AS down FROM s WINDOW w AS (PARTITION BY trace ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"""


@query("win03_polarity", f"WITH {POLAR} SELECT trace, idx, CASE WHEN up + down = 0 THEN 'FLAT' WHEN up >= 3 AND down >= 3 THEN 'OSCILLATE' WHEN up >= 2 * down AND up > 0 THEN 'STEP_UP' WHEN down >= 2 * up THEN 'STEP_DOWN' ELSE 'SPIKE_STEP' END AS polarity FROM n")
def polarity(spark, sf):
    d = samples(spark, sf).withColumn("delta", F.coalesce(F.col("amp") - F.lag("amp").over(_w()), F.lit(0.0)))
    w = _w().rowsBetween(-5, 5)
    n = d.withColumns({"up": F.count_if(F.col("delta") > 0.15).over(w), "down": F.count_if(F.col("delta") < -0.15).over(w)})
    up, down = F.col("up"), F.col("down")
    p = F.when(up + down == 0, "FLAT").when((up >= 3) & (down >= 3), "OSCILLATE").when((up >= down * 2) & (up > 0), "STEP_UP").when(down >= up * 2, "STEP_DOWN").otherwise("SPIKE_STEP")
    return n.select("trace", "idx", p.alias("polarity"))


@query("win26_envelope_health", f"""WITH {SAMPLES}, e AS (SELECT trace, idx, sqrt(avg(amp * amp) OVER (PARTITION BY trace ORDER BY idx ROWS 15 PRECEDING)) AS r FROM samples), k AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY r, idx) AS k, count(*) OVER (PARTITION BY trace) AS n FROM e)
  SELECT trace, round(least(1.0, greatest(0.0, (20 * log10(avg(r)) + 30) / 25)), 6) AS health FROM k WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY trace""")
def envelope_health(spark, sf):
    e = samples(spark, sf).withColumn("r", win.rms(F.col("amp"), win.trailing(["trace"], "idx", 16)))
    w = Window.partitionBy("trace")
    k = e.withColumns({"k": F.row_number().over(w.orderBy("r", "idx")), "n": F.count("*").over(w)}).where("k > floor(n * 0.1) AND k <= n - floor(n * 0.1)")
    return k.groupBy("trace").agg(F.round(clamp((F.log10(F.avg("r")) * 20 + 30) / 25, 0.0, 1.0), 6).alias("health"))


@query("win31_cut_segments", f"""WITH {FLUX}, c AS (SELECT track, idx, amp, sum(CASE WHEN label = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY idx) AS seg FROM flux) SELECT track, CAST(seg AS BIGINT) AS seg, min(idx) AS first, max(idx) AS last, round(avg(amp), 6) AS level FROM c GROUP BY track, seg""")
def cut_segments(spark, sf):
    w = Window.partitionBy("track").orderBy("idx")
    c = flux(spark, sf).withColumn("seg", F.sum(F.when(F.col("label") == "error", 1).otherwise(0)).over(w))
    return c.groupBy("track", "seg").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.round(F.avg("amp"), 6).alias("level"))


@query("win40_splice_map", f"""WITH {SAMPLES}, d AS (SELECT trace, label, idx, abs(lead(amp) OVER (PARTITION BY trace ORDER BY idx) - amp) AS d FROM samples), s AS (SELECT label, trace, arg_max(idx, (d, -idx)) AS pos FROM d WHERE d IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT label, list_sort(list(pos))[count(*) // 2 + 1] AS med FROM s GROUP BY label) SELECT s.label, any_value(med) AS med, round(avg(CASE WHEN abs(pos - med) <= 8 THEN 1.0 ELSE 0.0 END), 6) AS near FROM s JOIN m USING (label) GROUP BY s.label""")
def splice_map(spark, sf):
    d = samples(spark, sf).withColumn("d", F.abs(F.lead("amp").over(_w()) - F.col("amp"))).where("d IS NOT NULL")
    s = d.groupBy("label", "trace").agg(F.max_by("idx", F.struct("d", -F.col("idx"))).alias("pos"))
    r = Window.partitionBy("label")
    k = s.withColumns({"k": F.row_number().over(r.orderBy("pos", "trace")), "n": F.count("*").over(r)})
    m = k.where(F.col("k") == F.expr("n div 2") + 1).select("label", F.col("pos").alias("med"))  # the upper median
    return s.join(m, "label").groupBy("label").agg(F.max("med").alias("med"), F.round(F.avg(F.when(F.abs(F.col("pos") - F.col("med")) <= 8, 1.0).otherwise(0.0)), 6).alias("near"))


@query("win42_soft_bytes", f"""WITH {SAMPLES} SELECT trace, idx // 8 AS byte, CAST(sum(CASE WHEN amp > 0 THEN 1 << CAST(7 - idx % 8 AS INT) ELSE 0 END) AS BIGINT) AS value FROM samples GROUP BY 1, 2""")
def soft_bytes(spark, sf):
    bit = F.when(F.col("amp") > 0, F.expr("shiftleft(1, cast(7 - idx % 8 as int))")).otherwise(0)
    return samples(spark, sf).groupBy("trace", F.expr("idx div 8").alias("byte")).agg(F.sum(bit).alias("value"))


@query("win43_long_track", f"WITH {FLUX} SELECT track, count(*) AS length FROM flux GROUP BY track HAVING count(*) >= 70")
def long_track(spark, sf):
    return flux(spark, sf).groupBy("track").agg(F.count("*").alias("length")).where("length >= 70")


@query("win44_breakpoints", f"WITH {FLUX}, n AS (SELECT track, idx, label, lead(label) OVER w AS nxt, lag(label) OVER w AS prev FROM flux WINDOW w AS (PARTITION BY track ORDER BY idx)) SELECT track, idx FROM n WHERE label = prev AND label <> nxt")
def breakpoints(spark, sf):
    w = Window.partitionBy("track").orderBy("idx")
    n = flux(spark, sf).withColumns({"nxt": F.lead("label").over(w), "prev": F.lag("label").over(w)})
    return n.where("label = prev AND label <> nxt").select("track", "idx")


@query("agg13_integrity_summary", f"""WITH {SAMPLES}, c AS (SELECT trace, idx, abs(amp) < 0.05 AS hit FROM samples), g AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER (PARTITION BY trace ORDER BY idx), false) THEN 1 ELSE 0 END AS s FROM c)
  SELECT trace, CAST(sum(s) AS BIGINT) AS regions, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS flagged, round(1 - avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) - least(0.5, 0.02 * sum(s)), 6) AS score FROM g GROUP BY trace""")
def integrity_summary(spark, sf):
    c = samples(spark, sf).withColumn("hit", F.abs("amp") < 0.05)
    g = c.withColumn("s", F.when(F.col("hit") & ~F.coalesce(F.lag("hit").over(_w()), F.lit(False)), 1).otherwise(0))
    part = F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0))
    return g.groupBy("trace").agg(F.sum("s").alias("regions"), F.round(part, 6).alias("flagged"), F.round(1 - part - F.least(F.lit(0.5), F.sum("s") * 0.02), 6).alias("score"))


@query("agg21_crc_rates", f"""WITH {SECTORS}, f AS (SELECT track, sector, arg_min(crc_ok, read) AS original, bool_or(crc_ok) AS final FROM sectors GROUP BY 1, 2) SELECT track, round(avg(CASE WHEN original THEN 1.0 ELSE 0.0 END), 6) AS before, round(avg(CASE WHEN final THEN 1.0 ELSE 0.0 END), 6) AS after FROM f GROUP BY track""")
def crc_rates(spark, sf):
    f = sectors(spark, sf).groupBy("track", "sector").agg(F.min_by("crc_ok", "read").alias("original"), F.bool_or("crc_ok").alias("final"))
    rate = lambda c: F.round(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 6)
    return f.groupBy("track").agg(rate("original").alias("before"), rate("final").alias("after"))


@query("agg31_bounded_histogram", f"WITH {FLUX} SELECT dt // 1800000000 AS bin, count(*) AS n FROM flux WHERE dt IS NOT NULL AND dt // 1800000000 < 50 GROUP BY 1")
def bounded_histogram(spark, sf):
    b = F.expr("dt div 1800000000")
    return flux(spark, sf).where(b < 50).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("topk01_largest_gaps", f"WITH {FLUX}, r AS (SELECT track, idx, dt, row_number() OVER (PARTITION BY track ORDER BY dt DESC, idx) AS rank FROM flux WHERE dt IS NOT NULL) SELECT track, idx, dt, rank FROM r WHERE rank <= 5")
def largest_gaps(spark, sf):
    w = Window.partitionBy("track").orderBy(F.desc("dt"), "idx")
    return flux(spark, sf).where("dt IS NOT NULL").select("track", "idx", "dt", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 5")


@query("dec08_fuzzy_sync", """WITH w AS (SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, bit_count(xor(l_partkey & 255, 161)) AS h FROM lineitem),
  s AS (SELECT track, pos, h + lead(h) OVER o + lead(h, 2) OVER o AS d FROM w WINDOW o AS (PARTITION BY track ORDER BY pos)) SELECT track, pos, CAST(d AS BIGINT) AS distance, CAST(100 - 8 * d AS BIGINT) AS confidence FROM s WHERE d <= 9""")
def fuzzy_sync(spark, sf):
    o = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    h = F.bit_count(F.col("l_partkey").bitwiseAND(255).bitwiseXOR(161))
    d = h + F.lead(h).over(o) + F.lead(h, 2).over(o)
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("track"), (F.row_number().over(o) - 1).cast("long").alias("pos"), d.cast("long").alias("distance"))
    return s.where("distance <= 9").withColumn("confidence", 100 - F.col("distance") * 8)


def _mfm_sql() -> str:
    terms, prev = [], "0"
    for i in range(7, -1, -1):
        bit = f"((v >> {i}) & 1)"
        clock = f"(1 - greatest({bit}, {prev}))"
        terms += [f"({clock} << {2 * i + 1})", f"({bit} << {2 * i})"]
        prev = bit
    return " + ".join(terms)


@query("dec11_mfm_encode", f"WITH p AS (SELECT p_partkey AS id, p_partkey & 255 AS v FROM part) SELECT id, CAST({_mfm_sql()} AS BIGINT) AS word FROM p")
def mfm_encode(spark, sf):
    v = F.col("p_partkey").bitwiseAND(255)
    word, prev = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i in range(7, -1, -1):  # a clock stands between two zeros
        bit = F.shiftright(v, i).bitwiseAND(1)
        word, prev = word + F.shiftleft(1 - F.greatest(bit, prev), 2 * i + 1) + F.shiftleft(bit, 2 * i), bit
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), word.alias("word"))


@query("dec10_mfm_decode", "SELECT p_partkey AS id, CAST(" + " + ".join(f"(((p_partkey >> {2 * i}) & 1) << {i})" for i in range(8)) + " AS BIGINT) AS byte FROM part")
def mfm_decode(spark, sf):
    k = F.col("p_partkey")
    byte = F.lit(0).cast("long")
    for i in range(8):
        byte = byte + F.shiftleft(F.shiftright(k, 2 * i).bitwiseAND(1), i)
    return table(spark, sf, "part").select(k.alias("id"), byte.alias("byte"))
