"""Chunked streams: events come in parts, a stateful step per track gives chunks with a kept overlap, flushes and resets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.carriers import FLUX, PULSES, SAMPLES, flux, pulses, samples, table
from ..sources.storage import shared_folder
from ..streaming import pipeline as pipe
from .base import query

CHUNK, OVERLAP = 12, 4
STEP = CHUNK - OVERLAP
SERIES = f"{FLUX}, n AS (SELECT track, count(*) AS n FROM flux GROUP BY track), starts AS (SELECT track, s * {STEP} AS start, n FROM n, unnest(range(0, (n - {OVERLAP}) // {STEP})) AS u(s))"


def _drained(spark, rows):
    """Everything that the chunk pipeline gives for (track, seq, amp, kind) rows that come in parts."""
    at = shared_folder(spark, "chunks")
    pipe.drain(pipe.chunked(pipe.replayed(rows, f"{at}/in"), CHUNK, OVERLAP), f"{at}/out", f"{at}/state", "update")
    return spark.read.parquet(f"{at}/out")


def _events(spark, sf, reset: bool = False):
    """Each user's values numbered from 0; a reset behind every event whose number divides by 997."""
    e = flux(spark, sf).select("track", F.col("idx").alias("seq"), "amp", F.lit(pipe.DATA).alias("kind"))
    if not reset:
        return e
    w = Window.partitionBy("user_id").orderBy("event_id")
    t = table(spark, sf, "events").select("event_id", F.col("user_id").alias("track"), (F.row_number().over(w) - 1).cast("long").alias("seq"))
    return e.unionByName(t.where("event_id % 997 = 0").select("track", "seq", F.lit(0.0).alias("amp"), F.lit(pipe.RESET).alias("kind")))


def _pulses(spark, sf):
    return pulses(spark, sf).select("track", F.col("idx").alias("seq"), F.col("dt").cast("double").alias("amp"), F.lit(pipe.DATA).alias("kind"))


@query("str01_create", f"WITH {SERIES} SELECT track, n AS pushed, CAST(0 AS BIGINT) AS buffered, (n - {OVERLAP}) // {STEP} AS chunks FROM n")
def create(spark, sf):
    """What each track's state holds after all batches: samples pushed, samples buffered, chunks given."""
    out = _drained(spark, _events(spark, sf))
    last = out.where("length = 0").groupBy("track").agg(F.max_by(F.struct("pushed", "buffered"), "batch").alias("s"))
    full = out.where("length > 0 AND NOT flushed").groupBy("track").agg(F.count("*").alias("chunks"))
    return last.join(full, "track", "left").select("track", "s.pushed", "s.buffered", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("str02_push", f"WITH {SERIES} SELECT s.track, start, count(*) AS length, round(avg(amp), 6) AS mean FROM starts s JOIN flux f ON f.track = s.track AND f.idx >= start AND f.idx < start + {CHUNK} GROUP BY s.track, start")
def push(spark, sf):
    """Chunks as samples are pushed, each beginning with the end of the one before; no sample is dropped."""
    return _drained(spark, _events(spark, sf)).where("length > 0 AND NOT flushed").select("track", "start", "length", F.round("mean", 6).alias("mean"))


@query("str04_flush", f"WITH {SERIES}, r AS (SELECT track, greatest(0, (n - {OVERLAP}) // {STEP}) * {STEP} AS start, n FROM n) SELECT r.track, start, n - start AS length, round(avg(amp), 6) AS mean FROM r JOIN flux f ON f.track = r.track AND f.idx >= start WHERE n - start >= 4 GROUP BY 1, 2, 3")
def flush(spark, sf):
    return _drained(spark, _events(spark, sf)).where("flushed").select("track", "start", "length", F.round("mean", 6).alias("mean"))


@query("str05_reset", f"""WITH e AS (SELECT user_id AS track, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, sum(CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM events),
  p AS (SELECT track, coalesce(part, 0) AS part, min(idx) AS first, count(*) AS n FROM e GROUP BY 1, 2) SELECT track, first + s * {STEP} AS start FROM p, unnest(range(0, (n - {OVERLAP}) // {STEP})) AS u(s)""")
def reset(spark, sf):
    """A reset forgets what is buffered; chunks begin anew behind it."""
    return _drained(spark, _events(spark, sf, True)).where("length > 0 AND NOT flushed").select("track", "start")


@query("str03_windowed_chunks", f"""WITH {SERIES}, c AS (SELECT s.track, start, avg(amp) AS mean, count(*) FILTER (abs(amp) < 20) AS low FROM starts s JOIN flux f ON f.track = s.track AND f.idx >= start AND f.idx < start + {CHUNK} GROUP BY s.track, start)
  SELECT track, start, low AS dropouts, round(1 - low / {CHUNK}.0, 6) AS integrity, round(0.5 * (1 - low / {CHUNK}.0) + 0.5 * least(1.0, abs(mean) / 100), 8) AS confidence FROM c""")
def process_chunk(spark, sf):
    """Each chunk's dropouts, integrity and confidence."""
    c = _drained(spark, _events(spark, sf)).where("length > 0 AND NOT flushed")
    whole = 1 - F.col("low") / float(CHUNK)
    return c.select("track", "start", F.col("low").alias("dropouts"), F.round(whole, 6).alias("integrity"), F.round(whole * 0.5 + F.least(F.lit(1.0), F.abs("mean") / 100) * 0.5, 8).alias("confidence"))


NANO = f"{PULSES}, n AS (SELECT track, count(*) AS n FROM pulses GROUP BY track)"


@query("str07_bridge_push", f"WITH {NANO}, starts AS (SELECT track, s * {STEP} AS start FROM n, unnest(range(0, (n - {OVERLAP}) // {STEP})) AS u(s)) SELECT s.track, start, round(avg(dt), 6) AS mean FROM starts s JOIN pulses f ON f.track = s.track AND f.idx >= start AND f.idx < start + {CHUNK} GROUP BY s.track, start")
def bridge_push(spark, sf):
    """Intervals in nanoseconds pushed through the same pipeline."""
    return _drained(spark, _pulses(spark, sf)).where("length > 0 AND NOT flushed").select("track", "start", F.round("mean", 6).alias("mean"))


@query("str08_bridge_flush", f"WITH {NANO}, r AS (SELECT track, greatest(0, (n - {OVERLAP}) // {STEP}) * {STEP} AS start, n FROM n) SELECT r.track, start, n - start AS length, round(avg(dt), 6) AS mean FROM r JOIN pulses f ON f.track = r.track AND f.idx >= start WHERE n - start >= 4 GROUP BY 1, 2, 3")
def bridge_flush(spark, sf):
    return _drained(spark, _pulses(spark, sf)).where("flushed").select("track", "start", "length", F.round("mean", 6).alias("mean"))


@query("str09_full_pipeline", f"""WITH {SAMPLES}, f AS (SELECT trace, idx, abs(amp) < 0.02 AS low, abs(amp) >= 0.2 AS high, amp FROM samples), g AS (SELECT *, CASE WHEN low THEN 'LOW' WHEN high THEN 'HIGH' ELSE 'OK' END AS kind FROM f), h AS (SELECT *, idx - row_number() OVER (PARTITION BY trace, kind ORDER BY idx) AS grp FROM g),
  r AS (SELECT trace, count(*) AS n_events FROM (SELECT trace, kind, grp FROM h WHERE kind <> 'OK' GROUP BY 1, 2, 3 HAVING count(*) >= 1) GROUP BY trace), i AS (SELECT trace, avg(CASE WHEN kind = 'OK' THEN 1.0 ELSE 0.0 END) AS integ, avg(CASE WHEN kind = 'OK' THEN least(1.0, 0.4 + abs(amp) * 3) ELSE 0.2 END) AS conf FROM g GROUP BY trace)
  SELECT i.trace, coalesce(n_events, 0) AS events, round(integ, 6) AS integrity, round(conf, 6) AS confidence, round(greatest(0.0, least(1.0, 0.4 * integ + 0.4 * conf + 0.2 * (1 - 0.02 * coalesce(n_events, 0)))), 5) AS overall FROM i LEFT JOIN r ON r.trace = i.trace""")
def full_pipeline(spark, sf):
    """Integrity, confidence and events of whole traces, and one score from the three."""
    from ..operators import windows as win

    g = samples(spark, sf).withColumn("kind", F.when(F.abs("amp") < 0.02, "LOW").when(F.abs("amp") >= 0.2, "HIGH").otherwise("OK"))
    ok = F.col("kind") == "OK"
    i = g.groupBy("trace").agg(F.avg(ok.cast("double")).alias("integ"), F.avg(F.when(ok, F.least(F.lit(1.0), F.abs("amp") * 3 + 0.4)).otherwise(0.2)).alias("conf"))
    r = win.runs(g, ["trace"], "idx", F.col("kind")).where("run_label <> 'OK'").groupBy("trace").agg(F.count("*").alias("events"))
    j = i.join(r, "trace", "left").na.fill(0, ["events"])
    score = F.col("integ") * 0.4 + F.col("conf") * 0.4 + (1 - F.col("events") * 0.02) * 0.2
    return j.select("trace", "events", F.round("integ", 6).alias("integrity"), F.round("conf", 6).alias("confidence"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 5).alias("overall"))
