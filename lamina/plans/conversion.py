"""Conversion between formats: paths, the round-trip matrix, gates, jobs, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import probing as pr
from ..operators import tracks as tr
from ..sources.carriers import IMAGES, PULSES, SECTORS, images, pulses, sectors, turns
from ..sources.storage import stored
from .base import query
from .codes import ENCODED
from .filesystems import CATALOGUE, _catalogues, _listed
from .formats import CLAIMS, FILES, _files, _id, _picked
from .fusion_policy import MATRIX, PATHS, _sql_values

_TO = ["HFE", "SCP", "IMG", "ADF", "D64", "G64"]
POLICY = f"p AS (SELECT * FROM (VALUES {_sql_values(PATHS)}) AS t(src, dst, quality)), m AS (SELECT * FROM (VALUES {_sql_values(MATRIX)}) AS t(src, dst, status))"


def _paths(spark):
    return F.broadcast(spark.createDataFrame(PATHS, "src string, dst string, quality string"))  # 44 rows


def _matrix(spark):
    return F.broadcast(spark.createDataFrame(MATRIX, "src string, dst string, status string"))  # 13 rows


def _gated(spark, asked):
    """asked (src, dst, consent and more) with path quality, round-trip status and what the gate says."""
    j = asked.join(_paths(spark), ["src", "dst"], "left").join(_matrix(spark), ["src", "dst"], "left").withColumn("status", F.coalesce("status", F.lit("UNTESTED")))
    gate = F.when(F.col("quality").isNull(), "NO_PATH").when(F.col("status") == "LOSSLESS", "RUN").when((F.col("status") == "LOSSY_DOCUMENTED") & F.col("consent"), "RUN").when(F.col("status") == "LOSSY_DOCUMENTED", "NEEDS_CONSENT").otherwise("ABORT")
    return j.withColumn("outcome", gate)


GATE = "CASE WHEN quality IS NULL THEN 'NO_PATH' WHEN coalesce(status, 'UNTESTED') = 'LOSSLESS' THEN 'RUN' WHEN status = 'LOSSY_DOCUMENTED' AND consent THEN 'RUN' WHEN status = 'LOSSY_DOCUMENTED' THEN 'NEEDS_CONSENT' ELSE 'ABORT' END"


@query("conv01_convert_file", f"""WITH {CLAIMS}, {POLICY}, t AS (SELECT *, max(conf) OVER (PARTITION BY id) AS top FROM claims), w AS (SELECT id, arg_min(format, reg) AS src, count(*) AS tied FROM t WHERE conf = top GROUP BY id), a AS (SELECT files.id, src, tied, {_TO}[CAST(1 + files.id % {len(_TO)} AS BIGINT)] AS dst, files.id % 2 = 0 AS consent FROM files LEFT JOIN w ON w.id = files.id),
  g AS (SELECT a.*, CASE WHEN a.src IS NULL THEN 'UNKNOWN' WHEN tied > 1 THEN 'AMBIGUOUS' ELSE {GATE} END AS outcome, status FROM a LEFT JOIN p ON p.src = a.src AND p.dst = a.dst LEFT JOIN m ON m.src = a.src AND m.dst = a.dst) SELECT id, src, dst, outcome, outcome = 'RUN' AND coalesce(status, '') = 'LOSSY_DOCUMENTED' AS sidecar FROM g""")
def convert_file(spark, sf):
    """Probe the bytes, refuse what is unknown or ambiguous, look up the path, pass the gate; lossy runs get a sidecar."""
    files = _files(spark, sf)
    w = _id(pr.ranking(pr.claims(files))).select("id", F.col("winner").alias("src"), "tied")
    a = _id(files.select("path")).select("id", F.get(F.array(*map(F.lit, _TO)), (F.col("id") % len(_TO)).cast("int")).alias("dst"), (F.col("id") % 2 == 0).alias("consent")).join(w, "id", "left")
    out = F.when(F.col("src").isNull(), "UNKNOWN").when(F.col("tied") > 1, "AMBIGUOUS").otherwise(F.col("outcome"))
    return _gated(spark, a).select("id", "src", "dst", out.alias("outcome"), "status").select("id", "src", "dst", "outcome", ((F.col("outcome") == "RUN") & (F.col("status") == "LOSSY_DOCUMENTED")).alias("sidecar"))


@query("conv02_convert_memory", f"""WITH {FILES}, {POLICY}, a AS (SELECT id, upper(ext) AS src, {_TO}[CAST(1 + id % {len(_TO)} AS BIGINT)] AS dst, id % 2 = 0 AS consent FROM files) SELECT id, a.src, a.dst, {GATE} AS outcome FROM a LEFT JOIN p ON p.src = a.src AND p.dst = a.dst LEFT JOIN m ON m.src = a.src AND m.dst = a.dst""")
def convert_memory(spark, sf):
    """The same gate for a buffer whose format is given."""
    a = _picked(spark, sf).select("id", F.upper("ext").alias("src"), F.get(F.array(*map(F.lit, _TO)), (F.col("id") % len(_TO)).cast("int")).alias("dst"), (F.col("id") % 2 == 0).alias("consent"))
    return _gated(spark, a).select("id", "src", "dst", "outcome")


@query("conv03_dispatch", ENCODED[: ENCODED.index(" SELECT track, CAST(length(cells)")] + f""", w AS (SELECT track, string_agg(data, '' ORDER BY sector) AS data FROM turns GROUP BY track) SELECT 'IMG-HFE' AS route, track, md5(cells) AS digest FROM t WHERE track % 3 = 0 UNION ALL SELECT 'HFE-IMG', track, md5(data) FROM w WHERE track % 3 = 1
  UNION ALL SELECT 'SCP-HFE', track, md5(regexp_extract(cells, '^(.*1)0*$', 1)) FROM t WHERE track % 3 = 2""")
def dispatch(spark, sf):
    """Routes between sectors, cells and intervals, each pair with its own transform."""
    t = turns(spark, sf, 128)
    cells = tr.encode(t, "MFM")

    def to_cells(x):
        return x.select("track", F.md5("cells").alias("digest"))

    def to_sectors(x):
        got = tr.decode_mfm(x).groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sector", "data"))), lambda s: s["data"]), "").alias("data"))
        return got.select("track", F.md5("data").alias("digest"))

    routes = {"IMG-HFE": (0, to_cells), "HFE-IMG": (1, to_sectors), "SCP-HFE": (2, lambda x: to_cells(tr.from_runs(tr.runs(x))))}
    out = None
    for name, (part, run) in routes.items():
        got = run(cells.where(F.col("track") % 3 == part)).withColumn("route", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out.select("route", "track", "digest")


#: The format that each file's bytes say, as the probe ranks it.
PROBED = f"{CLAIMS}, t AS (SELECT *, max(conf) OVER (PARTITION BY id) AS top FROM claims), w AS (SELECT id, arg_min(format, reg) FILTER (conf = top) AS src FROM t GROUP BY id)"


def _probed(spark, sf):
    return _id(pr.ranking(pr.claims(_files(spark, sf)))).select("id", F.col("winner").alias("src"))


@query("conv04_preflight", f"""WITH {PROBED}, {POLICY} SELECT id, p.src, p.dst, quality, coalesce(status, 'UNTESTED') AS status, CASE coalesce(status, 'UNTESTED') WHEN 'LOSSLESS' THEN 'RUN' WHEN 'LOSSY_DOCUMENTED' THEN 'NEEDS_CONSENT' ELSE 'ABORT' END AS decision
  FROM w JOIN p ON p.src = w.src LEFT JOIN m ON p.src = m.src AND p.dst = m.dst""")
def preflight(spark, sf):
    """Every path that starts at a file's format, and what the gate would say."""
    j = _probed(spark, sf).join(_paths(spark), "src").join(_matrix(spark), ["src", "dst"], "left").withColumn("status", F.coalesce("status", F.lit("UNTESTED")))
    decision = F.when(F.col("status") == "LOSSLESS", "RUN").when(F.col("status") == "LOSSY_DOCUMENTED", "NEEDS_CONSENT").otherwise("ABORT")
    return j.select("id", "src", "dst", "quality", "status", decision.alias("decision"))


@query("conv05_preflight_gate", f"WITH {PROBED}, {POLICY}, g AS (SELECT DISTINCT dst AS x FROM p), a AS (SELECT w.id, w.src, g.x AS dst, false AS consent FROM w, g) SELECT a.id, a.src, a.dst, {GATE} AS outcome FROM a LEFT JOIN p ON p.src = a.src AND p.dst = a.dst LEFT JOIN m ON m.src = a.src AND m.dst = a.dst")
def preflight_gate(spark, sf):
    """Every file to every target through the one gate, without consent."""
    targets = F.array(*[F.lit(d) for d in sorted({d for _, d, _ in PATHS})])
    return _gated(spark, _probed(spark, sf).select("id", "src", F.explode(targets).alias("dst"), F.lit(False).alias("consent"))).select("id", "src", "dst", "outcome")


@query("join16_list_targets", f"WITH {PROBED}, {POLICY}, l AS (SELECT src, count(*) AS targets, string_agg(dst, ',' ORDER BY dst) AS list FROM p GROUP BY src) SELECT id, w.src, coalesce(targets, 0) AS targets, coalesce(list, '') AS list FROM w LEFT JOIN l ON l.src = w.src")
def list_targets(spark, sf):
    """The targets that each file can be converted to."""
    by = _paths(spark).groupBy("src").agg(F.count("*").alias("targets"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("list"))
    return _probed(spark, sf).join(F.broadcast(by), "src", "left").select("id", "src", F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("list", F.lit("")).alias("list"))


@query("join15_path_lookup", f"WITH {FILES}, {POLICY} SELECT id, p.src, p.dst, quality FROM files JOIN p ON p.src = upper(ext) AND p.dst = {_TO}[CAST(1 + id % {len(_TO)} AS BIGINT)]")
def path_lookup(spark, sf):
    a = _picked(spark, sf).select("id", F.upper("ext").alias("src"), F.get(F.array(*map(F.lit, _TO)), (F.col("id") % len(_TO)).cast("int")).alias("dst"))
    return a.join(_paths(spark), ["src", "dst"]).select("id", "src", "dst", "quality")


COPY = f"{SECTORS}, c AS (SELECT track, sector, arg_max(data, (crc_ok, -read)) AS data, bool_or(weak) AS weak, bool_or(deleted) AS deleted, bool_or(crc_ok) AS ok FROM sectors GROUP BY 1, 2)"


def _copied(spark, sf):
    return sectors(spark, sf).groupBy("track", "sector").agg(F.max_by("data", F.struct("crc_ok", -F.col("read"))).alias("data"), F.bool_or("weak").alias("weak"), F.bool_or("deleted").alias("deleted"), F.bool_or("crc_ok").alias("ok"))


@query("conv06_disk_convert", f"WITH {COPY} SELECT track, count(*) AS sectors, CAST(sum(data) AS BIGINT) AS total, count(*) FILTER (NOT ok) AS filled FROM c GROUP BY track")
def disk_convert(spark, sf):
    """Tracks copied into the target's form, written, and counted from there."""
    made = stored(_copied(spark, sf).select("track", "sector", "data", "ok"), "converted")
    return made.groupBy("track").agg(F.count("*").alias("sectors"), F.sum("data").alias("total"), F.count_if(~F.col("ok")).alias("filled"))


@query("conv07_disk_to_disk", f"WITH {COPY} SELECT track, count(*) AS copied, bool_or(weak) AS lost_weak, bool_or(deleted) AS lost_marks, bool_or(NOT ok) AS lost_checksums FROM c GROUP BY track")
def disk_to_disk(spark, sf):
    return _copied(spark, sf).groupBy("track").agg(F.count("*").alias("copied"), F.bool_or("weak").alias("lost_weak"), F.bool_or("deleted").alias("lost_marks"), F.bool_or(~F.col("ok")).alias("lost_checksums"))


# What each format can hold.
_CAPS = [("SCP", ["flux", "timing", "weak", "sectors"]), ("HFE", ["bits", "sectors"]), ("G64", ["bits", "timing", "weak", "sectors"]), ("D64", ["sectors", "errors"]), ("ADF", ["sectors"]), ("IMG", ["sectors"]), ("IMD", ["sectors", "marks", "errors"]), ("IPF", ["bits", "timing", "weak", "sectors"])]


@query("conv08_loss_report", f"""WITH {PROBED}, c AS (SELECT * FROM (VALUES {', '.join(map(str, _CAPS))}) AS t(format, caps)), x AS (SELECT a.format AS src, b.format AS dst, [x FOR x IN a.caps IF NOT list_contains(b.caps, x)] AS lost FROM c a, c b WHERE a.format <> b.format)
  SELECT id, x.src, dst, array_to_string(list_sort(lost), ',') AS lost, len(lost) > 0 AS lossy FROM w JOIN x ON x.src = w.src""")
def loss_report(spark, sf):
    """What each file's format can hold and each target cannot."""
    pairs = [(a, b, sorted(set(x) - set(y))) for a, x in _CAPS for b, y in _CAPS if a != b]
    report = F.broadcast(spark.createDataFrame(pairs, "src string, dst string, lost array<string>"))  # a row a pair of formats
    return _probed(spark, sf).join(report, "src").select("id", "src", "dst", F.array_join("lost", ",").alias("lost"), (F.size("lost") > 0).alias("lossy"))


JOBS = f"{SECTORS}, t AS (SELECT track, count(*) AS n, count(*) FILTER (crc_ok) AS ok, CAST(sum(data) AS BIGINT) AS total FROM sectors GROUP BY track), j AS (SELECT track, track // 10 AS batch, ['VERIFY', 'CONVERT', 'STATS'][CAST(1 + track % 3 AS BIGINT)] AS job, n, ok, total FROM t), r AS (SELECT *, CASE job WHEN 'VERIFY' THEN ok = n WHEN 'CONVERT' THEN ok > 0 ELSE true END AS good FROM j), f AS (SELECT batch, min(track) FILTER (NOT good) AS stop FROM r GROUP BY batch)"


@query("conv09_batch_run", f"WITH {JOBS} SELECT r.batch, track, job, CASE WHEN r.batch % 2 = 0 AND track > stop THEN 'SKIPPED' WHEN good THEN 'DONE' ELSE 'FAILED' END AS state, CASE WHEN job = 'STATS' AND NOT (r.batch % 2 = 0 AND coalesce(track > stop, false)) THEN total END AS total FROM r JOIN f ON f.batch = r.batch")
def batch_run(spark, sf):
    """Verify, convert and statistics jobs in batches; even batches stop behind their first failure."""
    from pyspark.sql import Window

    t = sectors(spark, sf).groupBy("track").agg(F.count("*").alias("n"), F.count_if("crc_ok").alias("ok"), F.sum("data").alias("total"))
    job = F.get(F.array(F.lit("VERIFY"), F.lit("CONVERT"), F.lit("STATS")), (F.col("track") % 3).cast("int"))
    r = t.withColumns({"batch": F.expr("track div 10"), "job": job}).withColumn("good", F.when(F.col("job") == "VERIFY", F.col("ok") == F.col("n")).when(F.col("job") == "CONVERT", F.col("ok") > 0).otherwise(True))
    r = r.withColumn("stop", F.min(F.when(~F.col("good"), F.col("track"))).over(Window.partitionBy("batch")))
    skip = (F.col("batch") % 2 == 0) & F.coalesce(F.col("track") > F.col("stop"), F.lit(False))
    return r.select("batch", "track", "job", F.when(skip, "SKIPPED").when(F.col("good"), "DONE").otherwise("FAILED").alias("state"), F.when((F.col("job") == "STATS") & ~skip, F.col("total")).alias("total"))


@query("conv10_write_gate", f"""WITH {SECTORS}, t AS (SELECT track, bool_and(crc_ok) AS fine, count(*) AS n, max(quality) AS q, bool_or(deleted) AS marks, track % 2 = 0 AS verified, track % 3 = 0 AS writable, track % 5 <> 0 AS snapshot FROM sectors GROUP BY track)
  SELECT track, CASE WHEN NOT writable THEN 'READ_ONLY' WHEN NOT snapshot THEN 'NO_SNAPSHOT' WHEN NOT verified THEN 'NOT_VERIFIED' WHEN NOT fine THEN 'SOURCE_BAD' WHEN q <= 5 THEN 'LOW_QUALITY' WHEN marks THEN 'MARKS' ELSE 'ALLOWED' END AS gate FROM t""")
def write_gate(spark, sf):
    """All conditions of a write in their order; the first that fails is the reason."""
    t = sectors(spark, sf).groupBy("track").agg(F.bool_and("crc_ok").alias("fine"), F.max("quality").alias("q"), F.bool_or("deleted").alias("marks"))
    k = F.col("track")
    return t.select("track", F.when(k % 3 != 0, "READ_ONLY").when(k % 5 == 0, "NO_SNAPSHOT").when(k % 2 != 0, "NOT_VERIFIED").when(~F.col("fine"), "SOURCE_BAD").when(F.col("q") <= 5, "LOW_QUALITY").when(F.col("marks"), "MARKS").otherwise("ALLOWED").alias("gate"))


@query("conv13_directory", f"WITH {CATALOGUE} SELECT disk, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, string_agg(CASE WHEN folder = '$' THEN '' ELSE folder || '.' END || 'P' || id || CASE WHEN locked THEN ' L' ELSE '' END, chr(10) ORDER BY i) AS listing FROM cat GROUP BY disk")
def directory(spark, sf):
    """A disk's files, a line each."""
    line = F.struct("slot", F.concat(F.col("name"), F.when(F.col("locked"), " L").otherwise("")).alias("t"))
    by = _listed(_catalogues(spark, sf)).groupBy("disk").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(line)).alias("l"))
    return by.select("disk", "files", "bytes", F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("listing"))


@query("conv14_hex_view", f"WITH {IMAGES} SELECT image, chunk * 256 + k * 16 AS position, substr(data, CAST(k * 32 + 1 AS BIGINT), 32) AS line FROM images, unnest(range(0, (length(data) + 31) // 32)) AS u(k)")
def hex_view(spark, sf):
    """All bytes of all images in lines of sixteen."""
    i = images(spark, sf).select("image", "chunk", F.posexplode(F.regexp_extract_all("data", F.lit(".{1,32}"), F.lit(0))).alias("k", "line"))
    return i.select("image", (F.col("chunk") * 256 + F.col("k") * 16).alias("position"), "line")


@query("conv15_info", f"WITH {SECTORS}, t AS (SELECT track, max(sector) AS top, count(*) AS n, count(DISTINCT sector) AS d, count(*) FILTER (crc_ok) AS ok FROM sectors GROUP BY track) SELECT top AS sectors_a_track, count(*) AS tracks, CAST(sum(n) AS BIGINT) AS reads, CAST(sum(d) AS BIGINT) AS sectors, CAST(sum(ok) AS BIGINT) AS good FROM t GROUP BY top")
def info(spark, sf):
    """Tracks by their number of sectors, with totals."""
    t = sectors(spark, sf).groupBy("track").agg(F.max("sector").alias("sectors_a_track"), F.count("*").alias("n"), F.count_distinct("sector").alias("d"), F.count_if("crc_ok").alias("ok"))
    return t.groupBy("sectors_a_track").agg(F.count("*").alias("tracks"), F.sum("n").alias("reads"), F.sum("d").alias("sectors"), F.sum("ok").alias("good"))


@query("conv17_flux_report", f"WITH {PULSES} SELECT track // 10 AS disk, dt // 100 AS bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY track // 10), 4) AS percent FROM pulses GROUP BY 1, 2")
def flux_report(spark, sf):
    from pyspark.sql import Window

    b = pulses(spark, sf).groupBy(F.expr("track div 10").alias("disk"), F.expr("dt div 100").alias("bin")).agg(F.count("*").alias("n"))
    return b.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("disk")), 4))
