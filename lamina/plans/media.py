"""Containers written and opened again, exports, iteration and lookups over tracks and sectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cells as cl
from ..operators import compare
from ..operators import signatures as sg
from ..operators import tracks as tr
from ..sources import containers as box
from ..sources.carriers import FLUX, IMAGES, PULSES, SECTORS, flux, images, pulses, sectors, table
from ..sources.storage import shared_folder, stored
from .base import query

#: Twenty tracks a disk; every eleventh interval is longer than a word holds.
TICKS = f"{PULSES}, ticks AS (SELECT track // 20 AS disk, track % 20 AS no, idx, dt // 25 + CASE WHEN idx % 11 = 0 THEN 65536 ELSE 0 END AS ticks FROM pulses)"


def _ticks(spark, sf):
    p = pulses(spark, sf)
    return p.select(F.expr("track div 20").cast("string").alias("path"), (F.col("track") % 20).alias("no"), "idx", (F.expr("dt div 25") + F.when(F.col("idx") % 11 == 0, 65536).otherwise(0)).alias("ticks"))


def _flux_images(spark, sf):
    return box.packed(_ticks(spark, sf), lambda parts: box.flux_image({no: box.encode_transitions(t) for no, t in parts.items()}))


OPENED = f"WITH {TICKS} SELECT CAST(disk AS VARCHAR) AS path, no AS track, count(*) + count(*) FILTER (ticks > 65535) AS words FROM ticks GROUP BY 1, 2"


@query("io01_open_image", OPENED)
def open_image(spark, sf):
    """Track tables of flux images kept in a stored table."""
    files = stored(_flux_images(spark, sf), "flux-images")
    return box.opened(files, box.open_flux_image, "track long, offset long, words long").drop("offset")


@query("io02_open_memory", OPENED)
def open_memory(spark, sf):
    return box.opened(_flux_images(spark, sf), box.open_flux_image, "track long, offset long, words long").drop("offset")


@query("io04_read_track_memory", f"WITH {TICKS} SELECT CAST(disk AS VARCHAR) AS path, no AS track, count(*) AS n, CAST(sum(ticks) * 25 AS BIGINT) AS total_ns, max(ticks) * 25 AS longest FROM ticks GROUP BY 1, 2")
def read_track_memory(spark, sf):
    """Every track's intervals out of the image; a zero word is a placeholder."""
    rows = lambda raw: [(no, i, int(t)) for no, _, _ in box.open_flux_image(raw) for i, t in enumerate(box.flux_track(raw, no)) if t]
    got = box.opened(_flux_images(spark, sf), rows, "track long, idx long, ticks long")
    return got.groupBy("path", "track").agg(F.count("*").alias("n"), (F.sum("ticks") * 25).alias("total_ns"), (F.max("ticks") * 25).alias("longest"))


@query("io05_checksum", f"WITH {TICKS} SELECT CAST(disk AS VARCHAR) AS path, true AS good, CASE WHEN disk % 2 = 0 THEN true ELSE false END AS damaged_passes FROM ticks GROUP BY disk")
def image_checksum(spark, sf):
    """The checksum of each image, and of one with its last byte turned round: only an image that may be written to passes then."""
    made = box.packed(_ticks(spark, sf), lambda parts: box.flux_image({no: box.encode_transitions(t) for no, t in parts.items()}))
    bad = lambda raw: box.checksum_ok(raw[:-1] + bytes([raw[-1] ^ 255]))
    writable = lambda raw: raw[:8] + b"\x04" + raw[9:]
    got = box.opened(made, lambda raw: [(box.checksum_ok(raw), bad(raw), bad(writable(raw)))], "good boolean, plain boolean, open boolean")
    return got.select("path", "good", F.when(F.col("path").cast("long") % 2 == 0, F.col("open")).otherwise(F.col("plain")).alias("damaged_passes"))


@query("io07_stream_decode", f"WITH {TICKS} SELECT CAST(disk AS VARCHAR) AS path, ticks, count(*) AS n FROM ticks GROUP BY 1, 2")
def stream_decode(spark, sf):
    """Opcode streams (one-, two- and three-byte intervals, overflow, blocks out of band) decoded again."""
    import numpy as np

    files = box.packed(_ticks(spark, sf), lambda parts: box.encode_stream(np.concatenate([parts[k] for k in sorted(parts)])))
    return box.transitions(files, box.decode_stream).groupBy("path", "ticks").agg(F.count("*").alias("n"))


@query("io11_captures", f"WITH {TICKS} SELECT CAST(disk AS VARCHAR) AS path, no AS location, count(*) AS n, CAST(sum(ticks) AS BIGINT) AS ticks FROM ticks GROUP BY 1, 2")
def captures(spark, sf):
    rows = lambda raw: [(no, len(t), int(t.sum())) for no, t in box.read_captures(raw)]
    return box.opened(box.packed(_ticks(spark, sf), box.capture_file), rows, "location long, n long, ticks long")


@query("io12_nibbles", f"""WITH {PULSES}, c AS (SELECT track, string_agg(repeat('0', CAST(greatest(1, floor(dt / 2000.0 + 0.5)) - 1 AS INT)) || '1', '' ORDER BY idx) AS cells FROM pulses GROUP BY track)
  SELECT track, array_to_string([printf('%02X', CAST(list_reduce([CAST(ascii(x) - 48 AS BIGINT) FOR x IN string_split(g, '')], lambda a, b: a * 2 + b) AS BIGINT)) FOR g IN regexp_extract_all(cells, '.{{8}}')], '') AS bytes FROM c""")
def nibbles(spark, sf):
    """Intervals to cells to bytes of eight cells each; there is no resynchronisation on set high bits."""
    runs = pulses(spark, sf).select("track", "idx", F.greatest(F.lit(1), F.floor(F.col("dt") / 2000.0 + 0.5)).alias("cells"))
    return tr.from_intervals(runs).select("track", cl.octets_of(F.col("cells")).alias("bytes"))


@query("io14_save", f"WITH {SECTORS} SELECT track % 16 AS disk, count(*) AS sectors, CAST(sum(data) AS BIGINT) AS total FROM sectors GROUP BY 1")
def save(spark, sf):
    """Sectors saved in the native form, a folder for each group of disks, and counted from there."""
    path = shared_folder(spark, "native")
    sectors(spark, sf).withColumn("disk", F.col("track") % 16).write.partitionBy("disk").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("disk").cast("long").alias("disk")).agg(F.count("*").alias("sectors"), F.sum("data").alias("total"))


@query("io15_load", f"WITH {SECTORS} SELECT track, sector, read, data, crc_ok FROM sectors WHERE track % 16 = 3")
def load(spark, sf):
    """One disk loaded from the native form: only its folder is read."""
    path = shared_folder(spark, "native")
    sectors(spark, sf).withColumn("disk", F.col("track") % 16).write.partitionBy("disk").parquet(path)
    return spark.read.parquet(path).where("disk = 3").select("track", "sector", "read", "data", "crc_ok")


@query("io17_validate", f"""WITH {SECTORS}, t AS (SELECT track, max(sector) AS top, count(DISTINCT sector) AS n, count(*) FILTER (sector < 1 OR sector > 7) AS out_of_range, count(*) FILTER (quality <= 0) AS no_quality, count(*) FILTER (data IS NULL) AS no_data, count(*) FILTER (crc_ok AND deleted AND weak) AS conflict FROM sectors GROUP BY track)
  SELECT count(*) AS tracks, count(*) FILTER (top <> n) AS gaps, CAST(sum(out_of_range) AS BIGINT) AS out_of_range, CAST(sum(no_quality) AS BIGINT) AS no_quality, CAST(sum(no_data) AS BIGINT) AS no_data, CAST(sum(conflict) AS BIGINT) AS conflicts, count(*) FILTER (track < 0) AS bad_number FROM t""")
def validate(spark, sf):
    """Errors by kind: sector numbers and gaps, qualities, missing data, marks that contradict each other."""
    n = F.count_if
    t = sectors(spark, sf).groupBy("track").agg(F.max("sector").alias("top"), F.count_distinct("sector").alias("n"), n(~F.col("sector").between(1, 7)).alias("o"), n(F.col("quality") <= 0).alias("q"), n(F.col("data").isNull()).alias("d"),
                                                n(F.col("crc_ok") & F.col("deleted") & F.col("weak")).alias("c"))
    return t.agg(F.count("*").alias("tracks"), n(F.col("top") != F.col("n")).alias("gaps"), F.sum("o").alias("out_of_range"), F.sum("q").alias("no_quality"), F.sum("d").alias("no_data"), F.sum("c").alias("conflicts"), n(F.col("track") < 0).alias("bad_number"))


@query("io19_sector_image", """WITH d AS (SELECT doc_id AS image, CAST(strlen(text) AS BIGINT) AS n, CAST(ord(substr(text, 1, 1)) AS BIGINT) % 3 AS kind FROM documents WHERE length(text) > 0), s AS (SELECT image, n, CASE kind WHEN 0 THEN 128 WHEN 1 THEN 256 ELSE 512 END AS size FROM d)
  SELECT image, size, (n + size - 1) // size AS sectors, (n - 1) % size + 1 AS last_bytes FROM s""")
def sector_images(spark, sf):
    """Each image is opened by the reader that its first character asks for, which cuts it into its sectors."""
    docs = table(spark, sf, "documents").where("length(text) > 0").withColumn("kind", F.ascii("text") % 3)
    out = None
    for kind, size in enumerate((128, 256, 512)):
        part = box.sector_image(docs.where(F.col("kind") == kind).select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content")), size)
        got = part.groupBy(F.col("path").cast("long").alias("image")).agg(F.lit(size).alias("size"), F.count("*").alias("sectors"), F.max_by(F.length("data"), "sector").cast("long").alias("last_bytes"))
        out = got if out is None else out.unionByName(got)
    return out


STATS = f"{SECTORS}, t AS (SELECT track, count(*) AS sectors, count(*) FILTER (crc_ok) AS good, count(*) FILTER (weak) AS weak, round(avg(quality), 3) AS quality FROM sectors GROUP BY track)"


def _stats(spark, sf):
    return sectors(spark, sf).groupBy("track").agg(F.count("*").alias("sectors"), F.count_if("crc_ok").alias("good"), F.count_if("weak").alias("weak"), F.round(F.avg("quality"), 3).alias("quality"))


@query("io20_stats_json", f"""WITH {STATS} SELECT track, '{{"sectors":' || sectors || ',"good":' || good || ',"weak":' || weak || '}}' AS report FROM t""")
def stats_json(spark, sf):
    return _stats(spark, sf).select("track", F.to_json(F.struct("sectors", "good", "weak")).alias("report"))


COMPARED = f"{SECTORS}, c AS (SELECT a.track, count(*) AS compared, count(*) FILTER (a.data = b.data) AS same FROM sectors a JOIN sectors b ON a.track = b.track AND a.sector = b.sector AND a.read = 0 AND b.read = 1 GROUP BY a.track)"


def _compared(spark, sf):
    s = sectors(spark, sf)
    b = s.where("read = 1").select("track", "sector", F.col("data").alias("other"))
    return s.where("read = 0").join(b, ["track", "sector"]).groupBy("track").agg(F.count("*").alias("compared"), F.count_if(F.col("data") == F.col("other")).alias("same"))


@query("io21_compare_json", f"""WITH {COMPARED} SELECT track, '{{"compared":' || compared || ',"identical":' || same || ',"equal":' || CASE WHEN compared = same THEN 'true' ELSE 'false' END || '}}' AS report FROM c""")
def compare_json(spark, sf):
    return _compared(spark, sf).select("track", F.to_json(F.struct("compared", F.col("same").alias("identical"), (F.col("compared") == F.col("same")).alias("equal"))).alias("report"))


@query("io22_verify_json", f"""WITH {COMPARED} SELECT track, '{{"status":"' || CASE WHEN compared = same THEN 'OK' ELSE 'FAILED' END || '","failed":' || (compared - same) || '}}' AS report FROM c""")
def verify_json(spark, sf):
    status = F.when(F.col("compared") == F.col("same"), "OK").otherwise("FAILED")
    return _compared(spark, sf).select("track", F.to_json(F.struct(status.alias("status"), (F.col("compared") - F.col("same")).alias("failed"))).alias("report"))


@query("io23_loss_sidecar", f"WITH {STATS} SELECT track, sectors - good AS lost, weak FROM t WHERE good < sectors OR weak > 0")
def loss_sidecar(spark, sf):
    """What a conversion would lose, written as JSON beside the image and read back."""
    path = shared_folder(spark, "loss")
    _stats(spark, sf).where("good < sectors OR weak > 0").select("track", (F.col("sectors") - F.col("good")).alias("lost"), "weak").write.json(path)
    return spark.read.schema("track long, lost long, weak long").json(path)


def _lines(spark, df, label: str):
    """The lines of a frame written as CSV."""
    path = shared_folder(spark, label)
    df.write.csv(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("io24_track_csv", f"WITH {PULSES} SELECT track || ',' || idx || ',' || dt AS line FROM pulses")
def track_csv(spark, sf):
    return _lines(spark, pulses(spark, sf).select("track", "idx", "dt"), "track-csv")


@query("io25_events_csv", "SELECT user_id || ',' || event_id || ',' || event_type AS line FROM events WHERE event_type = 'error'")
def events_csv(spark, sf):
    return _lines(spark, table(spark, sf, "events").where("event_type = 'error'").select("user_id", "event_id", "event_type"), "events-csv")


@query("io26_heat_map_pgm", f"""WITH {PULSES}, b AS (SELECT track, least(idx // 8, 7) AS c, CAST(floor(least(255, avg(dt) / 32)) AS BIGINT) AS grey FROM pulses GROUP BY 1, 2)
  SELECT track + 3 AS row_no, line FROM (SELECT t.track, string_agg(CAST(coalesce(b.grey, 0) AS VARCHAR), ' ' ORDER BY k) AS line FROM (SELECT DISTINCT track FROM b) t CROSS JOIN range(0, 8) AS g(k) LEFT JOIN b ON b.track = t.track AND b.c = k GROUP BY t.track) UNION ALL SELECT 0, 'P2' UNION ALL SELECT 1, '8 ' || (SELECT count(DISTINCT track) FROM b) UNION ALL SELECT 2, '255'""")
def heat_map_pgm(spark, sf):
    """A grey map of eight columns a track: three header lines, then a line a track."""
    b = pulses(spark, sf).groupBy("track", F.least(F.expr("idx div 8"), F.lit(7)).alias("c")).agg(F.floor(F.least(F.lit(255.0), F.avg("dt") / 32)).alias("grey"))
    m = b.groupBy("track").agg(F.map_from_entries(F.collect_list(F.struct("c", "grey"))).alias("m"))  # eight columns
    rows = m.select((F.col("track") + 3).alias("row_no"), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("string")), " ").alias("line"))
    line = lambda no, text: F.struct(F.lit(no).cast("long").alias("row_no"), text.alias("line"))
    head = m.agg(F.count("*").alias("n")).select(F.explode(F.array(line(0, F.lit("P2")), line(1, F.concat(F.lit("8 "), F.col("n").cast("string"))), line(2, F.lit("255")))).alias("h")).select("h.*")
    return head.unionByName(rows)


@query("io27_export", f"""WITH {STATS} SELECT 'csv' AS form, track || ',' || sectors || ',' || good AS line FROM t UNION ALL SELECT 'json', '{{"track":' || track || ',"sectors":' || sectors || ',"good":' || good || '}}' FROM t""")
def export(spark, sf):
    """The same report as CSV and as JSON lines."""
    r = _stats(spark, sf).select("track", "sectors", "good")
    path = shared_folder(spark, "export")
    r.write.json(path)
    return _lines(spark, r, "export-csv").select(F.lit("csv").alias("form"), "line").unionByName(spark.read.text(path).select(F.lit("json").alias("form"), F.col("value").alias("line")))


@query("io28_metrics_csv", f"WITH {STATS} SELECT track || ',' || sectors || ',' || good || ',' || CAST(100 * good // sectors AS VARCHAR) AS line FROM t")
def metrics_csv(spark, sf):
    return _lines(spark, _stats(spark, sf).select("track", "sectors", "good", F.expr("100 * good div sectors").alias("percent")), "metrics-csv")


@query("io32_slices_at_index", f"""WITH {PULSES}, t AS (SELECT track, idx, sum(dt) OVER (PARTITION BY track ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ns FROM pulses), i AS (SELECT track, k, k * 100000 AS lo, (k + 1) * 100000 AS hi FROM (SELECT track, max(ns) AS top FROM t GROUP BY track), unnest(range(0, CAST(top // 100000 + 1 AS BIGINT))) AS u(k))
  SELECT i.track, k AS revolution, count(*) AS n, CAST(min(ns) - max(lo) AS BIGINT) AS first_ns, CAST(max(ns) - max(lo) AS BIGINT) AS last_ns FROM i JOIN t ON t.track = i.track AND ns >= lo AND ns < hi GROUP BY 1, 2""")
def slices_at_index(spark, sf):
    """Transitions cut at index times 100,000 ns apart, in cumulative time: a range join to even bounds is a division."""
    t = pulses(spark, sf).withColumn("ns", F.sum("dt").over(Window.partitionBy("track").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    rel = F.col("ns") % 100000
    return t.groupBy("track", F.expr("ns div 100000").alias("revolution")).agg(F.count("*").alias("n"), F.min(rel).alias("first_ns"), F.max(rel).alias("last_ns"))


VISITS = f"""{FLUX}, t AS (SELECT track, track // 10 AS disk, 1 + count(*) FILTER (label = 'error') % 4 AS needs, count(*) AS n FROM flux GROUP BY track), o AS (SELECT *, row_number() OVER (PARTITION BY disk ORDER BY CASE disk % 3 WHEN 0 THEN track WHEN 1 THEN -track ELSE (1 - track % 2) * 1000000 + track END) AS step FROM t),
  f AS (SELECT disk, min(step) AS stop FROM o WHERE needs > 3 GROUP BY disk)"""


@query("scan01_track_iterator", f"WITH {VISITS} SELECT o.disk, track, step, least(needs, 3) AS attempts, needs <= 3 AS read, n FROM o LEFT JOIN f ON f.disk = o.disk WHERE o.disk % 2 = 0 OR stop IS NULL OR step <= stop")
def track_iterator(spark, sf):
    """Tracks of each disk in its order (up, down, odd before even), read again up to twice; odd disks stop at the first that fails."""
    t = flux(spark, sf).groupBy("track").agg((F.count_if(F.col("label") == "error") % 4 + 1).alias("needs"), F.count("*").alias("n")).withColumn("disk", F.expr("track div 10"))
    k = F.col("track")
    order = F.when(F.col("disk") % 3 == 0, k).when(F.col("disk") % 3 == 1, -k).otherwise((1 - k % 2) * 1000000 + k)
    o = t.withColumn("step", F.row_number().over(Window.partitionBy("disk").orderBy(order)).cast("long"))
    stop = F.min(F.when(F.col("needs") > 3, F.col("step"))).over(Window.partitionBy("disk"))
    go = o.withColumn("stop", stop).where("disk % 2 = 0 OR stop IS NULL OR step <= stop")
    return go.select("disk", "track", "step", F.least("needs", F.lit(3)).alias("attempts"), (F.col("needs") <= 3).alias("read"), "n")


@query("scan06_read_sector", f"WITH {SECTORS}, r AS (SELECT o_orderkey AS track, 1 + o_orderkey % 7 AS sector FROM orders) SELECT r.track, r.sector, arg_max(data, (quality, -read)) AS data, max(quality) AS quality, count(data) > 0 AS found FROM r LEFT JOIN sectors s ON s.track = r.track AND s.sector = r.sector GROUP BY 1, 2")
def read_sector(spark, sf):
    """Single sectors asked for by track and number: the read of the best quality."""
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("track"), (F.col("o_orderkey") % 7 + 1).alias("sector"))
    best = F.max_by("data", F.struct("quality", -F.col("read")))
    return r.join(sectors(spark, sf), ["track", "sector"], "left").groupBy("track", "sector").agg(best.alias("data"), F.max("quality").alias("quality"), (F.count("data") > 0).alias("found"))


@query("scan07_get_track", f"WITH {PULSES} SELECT track // 2 AS cyl, track % 2 AS head, count(*) AS n, CAST(sum(dt) AS BIGINT) AS ns FROM pulses GROUP BY 1, 2")
def get_track(spark, sf):
    p = pulses(spark, sf)
    return p.groupBy(F.expr("track div 2").alias("cyl"), (F.col("track") % 2).alias("head")).agg(F.count("*").alias("n"), F.sum("dt").alias("ns"))


@query("scan10_metadata_remove", "WITH l AS (SELECT user_id AS disk, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT disk, count(*) AS kept, string_agg(key, ',' ORDER BY key) AS keys FROM l WHERE key NOT IN ('error', 'click') GROUP BY disk")
def metadata_remove(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    m = last.groupBy(F.col("user_id").alias("disk")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))  # a few keys a disk
    left = F.map_filter("m", lambda k, v: ~k.isin("error", "click"))
    return m.select("disk", F.size(left).cast("long").alias("kept"), F.array_join(F.array_sort(F.map_keys(left)), ",").alias("keys")).where("kept > 0")


@query("scan12_annotate", "WITH n AS (SELECT user_id AS disk, event_id, CASE WHEN event_type = 'error' THEN 'error@' || event_id WHEN event_type = 'purchase' THEN 'seen@' || event_id END AS note FROM events) SELECT disk, 'disk ' || disk || ';' || string_agg(note, ';' ORDER BY event_id) AS notes FROM n WHERE note IS NOT NULL GROUP BY disk")
def annotate(spark, sf):
    """Notes appended in order to what each disk already has."""
    e = table(spark, sf, "events").where("event_type IN ('error', 'purchase')")
    note = F.struct("event_id", F.concat(F.when(F.col("event_type") == "error", "error@").otherwise("seen@"), F.col("event_id").cast("string")).alias("t"))
    by = e.groupBy(F.col("user_id").alias("disk")).agg(F.array_sort(F.collect_list(note)).alias("n"))
    old = F.concat(F.lit("disk "), F.col("disk").cast("string"))
    return by.select("disk", F.concat_ws(";", old, F.array_join(F.transform("n", lambda s: s["t"]), ";")).alias("notes"))


@query("scan13_find_pattern", "SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(lower(p_name), '^.*i.get.*$')")
def find_pattern(spark, sf):
    """Names that meet a pattern of #? (anything) and ? (one character), whatever their case."""
    pattern = "#?i?get#?".replace("#?", "\0").replace("?", ".").replace("\0", ".*")
    return table(spark, sf, "part").where(F.lower("p_name").rlike(f"^{pattern}$")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("join02_pair_visitor", f"""WITH {SECTORS}, a AS (SELECT track, sector, CASE WHEN weak AND deleted THEN NULL ELSE data END AS data, quality, crc_ok FROM sectors WHERE read = 0), b AS (SELECT track, sector, CASE WHEN weak AND deleted THEN NULL ELSE data END AS data, quality, crc_ok FROM sectors WHERE read = 1)
  SELECT coalesce(a.track, b.track) AS track, coalesce(a.sector, b.sector) AS sector, CASE WHEN a.track IS NULL OR b.track IS NULL THEN 'MISSING' WHEN a.quality <> b.quality THEN 'SIZE' WHEN a.data IS NULL OR b.data IS NULL THEN 'NULL' WHEN a.data <> b.data THEN 'DATA' WHEN a.crc_ok <> b.crc_ok THEN 'STATUS' ELSE 'SAME' END AS verdict FROM a FULL JOIN b ON a.track = b.track AND a.sector = b.sector""")
def pair_visitor(spark, sf):
    """One verdict a pair; missing comes before size, null, data and status."""
    s = sectors(spark, sf).withColumn("data", F.when(~(F.col("weak") & F.col("deleted")), F.col("data")))
    side = lambda n: s.where(f"read = {n}").select("track", "sector", *[F.col(c).alias(f"{c}{n}") for c in ("data", "quality", "crc_ok")], F.lit(True).alias(f"in{n}"))
    v = (F.when(F.col("in0").isNull() | F.col("in1").isNull(), "MISSING").when(F.col("quality0") != F.col("quality1"), "SIZE").when(F.col("data0").isNull() | F.col("data1").isNull(), "NULL").when(F.col("data0") != F.col("data1"), "DATA")
         .when(F.col("crc_ok0") != F.col("crc_ok1"), "STATUS").otherwise("SAME"))
    return side(0).join(side(1), ["track", "sector"], "full").select("track", "sector", v.alias("verdict"))


@query("join03_file_compare", f"""WITH {IMAGES}, a AS (SELECT * FROM images WHERE image % 2 = 0), b AS (SELECT image - 1 AS image, chunk, data FROM images WHERE image % 2 = 1), j AS (SELECT coalesce(a.image, b.image) AS image, a.data AS x, b.data AS y FROM a FULL JOIN b ON a.image = b.image AND a.chunk = b.chunk)
  SELECT image, count(*) AS chunks, count(*) FILTER (x = y) AS identical, count(*) FILTER (x <> y) AS different, count(*) FILTER (x IS NULL OR y IS NULL) AS single, CASE WHEN max(coalesce(length(x), 0)) + max(coalesce(length(y), 0)) = 0 THEN 'EMPTY' WHEN count(x) <= 8 THEN 'SMALL' ELSE 'LARGE' END AS geometry FROM j GROUP BY image""")
def file_compare(spark, sf):
    """Two files chunk by chunk; a digest of each chunk crosses the join, not the chunk."""
    i = images(spark, sf).select("image", "chunk", F.sha2("data", 256).alias("h"))
    a = i.where("image % 2 = 0").withColumnRenamed("h", "x")
    b = i.where("image % 2 = 1").select((F.col("image") - 1).alias("image"), "chunk", F.col("h").alias("y"))
    n = F.count_if
    same = F.col("x") == F.col("y")
    g = F.when(F.count("x") + F.count("y") == 0, "EMPTY").when(F.count("x") <= 8, "SMALL").otherwise("LARGE")
    return a.join(b, ["image", "chunk"], "full").groupBy("image").agg(F.count("*").alias("chunks"), n(same).alias("identical"), n(~same).alias("different"), n(F.col("x").isNull() | F.col("y").isNull()).alias("single"), g.alias("geometry"))


@query("join11_flux_verify", f"""WITH {PULSES}, {SECTORS}, d AS (SELECT track, md5(string_agg(CAST(dt AS VARCHAR), ',' ORDER BY idx)) AS h FROM pulses GROUP BY track), r AS (SELECT track, CASE WHEN track % 4 = 0 THEN 'x' ELSE h END AS h FROM d), s AS (SELECT track, bool_and(crc_ok) AS ok FROM sectors GROUP BY track)
  SELECT d.track, CASE WHEN d.h = r.h THEN 'RAW' WHEN s.ok THEN 'SECTORS' ELSE 'FAILED' END AS verified FROM d JOIN r ON r.track = d.track LEFT JOIN s ON s.track = d.track""")
def flux_verify(spark, sf):
    """Raw equality with a reference first; where it fails, the sectors decide."""
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "dt"))), lambda s: s["dt"].cast("string")), ",")
    d = pulses(spark, sf).groupBy("track").agg(F.md5(each).alias("h"))
    ref = d.select("track", F.when(F.col("track") % 4 == 0, "x").otherwise(F.col("h")).alias("r"))
    s = sectors(spark, sf).groupBy("track").agg(F.bool_and("crc_ok").alias("ok"))
    return d.join(ref, "track").join(s, "track", "left").select("track", F.when(F.col("h") == F.col("r"), "RAW").when(F.col("ok"), "SECTORS").otherwise("FAILED").alias("verified"))


_PIECES = "(length(data) // 2 - 1) // 10 + 1"
_PIECE = "substr(data, CAST(2 * (i * (length(data) // 2) // n) + 1 AS INTEGER), CAST(2 * ((i + 1) * (length(data) // 2) // n - i * (length(data) // 2) // n) AS INTEGER))"


@query("join18_duplicate_recovery", f"""WITH {IMAGES}, good AS (SELECT data, {_PIECES} AS n, min(image * 1000000 + chunk) AS spot FROM images WHERE (image + chunk) % 10 <> 0 GROUP BY data), bad AS (SELECT data, {_PIECES} AS n FROM images WHERE (image + chunk) % 10 = 0 GROUP BY data),
  p AS (SELECT i, {_PIECE} AS piece, data, spot FROM good, unnest(range(0, n)) AS r(i)), q AS (SELECT i, {_PIECE} AS piece, data FROM bad, unnest(range(0, n)) AS r(i)), c AS (SELECT DISTINCT q.data AS x, p.data AS y, p.spot FROM q JOIN p ON p.i = q.i AND p.piece = q.piece AND length(p.data) = length(q.data)),
  s AS (SELECT x, spot, len([k FOR k IN range(0, length(x) // 2) IF substr(x, CAST(k * 2 + 1 AS INTEGER), 2) = substr(y, CAST(k * 2 + 1 AS INTEGER), 2)]) AS same FROM c), m AS (SELECT x, min(spot) AS spot, arg_min(same, spot) AS same FROM s WHERE same * 100 > length(x) // 2 * 90 GROUP BY x)
  SELECT image, chunk, spot // 1000000 AS from_image, spot % 1000000 AS from_chunk, CAST(same AS BIGINT) AS equal_bytes FROM images JOIN m ON m.x = data WHERE (image + chunk) % 10 = 0""")
def duplicate_recovery(spark, sf):
    """Bad chunks of any length take the first good one of their length with more than nine tenths equal bytes.

    Of n bytes at most (n - 1) div 10 differ then, so one of one more pieces agrees: candidates meet in equal pieces, never all with
    all, and a pair leaves the join only where its sketches differ in no more bits than bytes may; equal chunks stand once on either side, and bytes are
    compared as arrays."""
    f = images(spark, sf).select("image", "chunk", F.unhex("data").alias("data"), ((F.col("image") + F.col("chunk")) % 10 == 0).alias("bad"))
    each = f.repartition("data").groupBy("bad", "data").agg(F.min(F.struct("image", "chunk")).alias("at")).select("bad", "data", "at.image", "at.chunk")  # dealt first: nothing is sorted beside the reading
    once = stored(compare.sketches(each, "data"), "chunks")
    size = F.octet_length("data")
    most = ((size - 1) / 10).cast("int")
    cut = lambda i: F.floor(i * size / (most + 1)).cast("int")
    hashed = F.explode(F.transform(F.sequence(F.lit(0), most), lambda i: F.xxhash64(F.substring("data", cut(i) + 1, cut(i + 1) - cut(i)), i, size)))
    side = lambda bad, name: once.where("bad" if bad else "NOT bad").withColumnsRenamed({"image": f"{name}_image", "chunk": f"{name}_chunk"})
    p = side(False, "good").select("good_image", "good_chunk", F.col("s0").alias("g0"), F.col("s1").alias("g1"), hashed.alias("h"))
    q = side(True, "bad").select("bad_image", "bad_chunk", "s0", "s1", most.alias("most"), hashed.alias("h"))
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("g1")))
    good_at, bad_at = ["good_image", "good_chunk"], ["bad_image", "bad_chunk"]
    c = q.withColumnRenamed("h", "k").join(p, (F.col("k") == F.col("h")) & (apart <= F.col("most"))).select(*bad_at, *good_at).distinct()
    both = c.join(side(True, "bad").select(*bad_at, F.col("data").alias("x")), bad_at).join(side(False, "good").select(*good_at, F.col("data").alias("y")), good_at)
    near = compare.equal_bytes(both, "x", "y").where("same * 100 > octet_length(x) * 90 AND octet_length(x) = octet_length(y)")
    first = near.groupBy("x").agg(F.min(F.struct(*good_at, "same")).alias("m"))
    return f.where("bad").join(first, F.col("data") == F.col("x")).select("image", "chunk", F.col("m.good_image").alias("from_image"), F.col("m.good_chunk").alias("from_chunk"), F.col("m.same").alias("equal_bytes"))


#: Signatures: every 24th byte of each benchmark text begins one of twelve bytes; the fourth is fixed in its high half only, the sixth is free.
_CUT, _MASK = 24, "FFFFFFF0FF00FFFFFFFFFFFF"
SIGNED = f"""sigs AS (SELECT item_id * 100000 + i AS sig, substr(h, CAST(2 * {_CUT} * i + 1 AS INTEGER), 24) AS p FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark) b, unnest(range(0, (length(h) // 2 - 12) // {_CUT} + 1)) AS u(i))"""


def _signatures(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").cast("binary").alias("b"))
    each = b.select("item_id", "b", F.explode(F.sequence(F.lit(0), F.expr(f"(octet_length(b) - 12) div {_CUT}"))).alias("i")).where(F.octet_length("b") >= 12)
    return each.select((F.col("item_id") * 100000 + F.col("i")).alias("sig"), F.substring("b", F.col("i") * _CUT + 1, F.lit(12)).alias("pattern"), F.unhex(F.lit(_MASK)).alias("mask"))


@query("join21_signature_scan", f"""WITH {SIGNED}, h AS (SELECT doc_id AS image, hex(encode(text)) AS h FROM documents WHERE length(text) > 0), c AS (SELECT image, k * 500 AS start, substr(h, CAST(1000 * k + 1 AS INTEGER), 1022) AS part FROM h, unnest(range(0, length(h) // 1000 + 1)) AS u(k)),
  w AS (SELECT image, start + i AS i, substr(part, CAST(2 * i + 1 AS INTEGER), 24) AS w FROM c, unnest(range(0, length(part) // 2 - 11)) AS u(i))
  SELECT image, sig, CAST(min(i) AS BIGINT) AS offset_at FROM w JOIN sigs ON substr(w, 1, 7) = substr(p, 1, 7) AND substr(w, 9, 2) = substr(p, 9, 2) AND substr(w, 13) = substr(p, 13) GROUP BY image, sig""")
def signature_scan(spark, sf):
    """A table of hundreds of masked signatures in every whole text: the first place of each."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    return sg.scan(texts, _signatures(spark, sf)).withColumnRenamed("key", "image")


@query("agg19_bad_sectors", f"WITH {SECTORS} SELECT track, sector, read, count(*) OVER () AS found FROM sectors WHERE NOT crc_ok")
def bad_sectors(spark, sf):
    """All bad sectors with their number."""
    bad = sectors(spark, sf).where(~F.col("crc_ok")).select("track", "sector", "read")
    return bad.crossJoin(F.broadcast(bad.agg(F.count("*").alias("found"))))  # one row


@query("agg02_track_visitor", f"""WITH {SECTORS}, s AS (SELECT track, CASE WHEN weak AND deleted THEN 'missing' WHEN NOT crc_ok THEN 'crc_error' ELSE 'ok' END AS state FROM sectors) SELECT track, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'crc_error') AS crc_error, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'ok') > 0 OR count(*) = 0 AS readable FROM s GROUP BY track""")
def track_visitor(spark, sf):
    state = F.when(F.col("weak") & F.col("deleted"), "missing").when(~F.col("crc_ok"), "crc_error").otherwise("ok")
    n = lambda s: F.count_if(F.col("state") == s)
    return sectors(spark, sf).withColumn("state", state).groupBy("track").agg(n("missing").alias("missing"), n("crc_error").alias("crc_error"), n("ok").alias("ok"), (n("ok") > 0).alias("readable"))


@query("agg14_quick_scan_summary", f"WITH {SECTORS}, t AS (SELECT track, count(*) AS n, count(*) FILTER (crc_ok) AS ok FROM sectors GROUP BY track) SELECT count(*) AS tracks, count(*) FILTER (ok = n) AS good, count(*) FILTER (ok > 0 AND ok < n) AS degraded, count(*) FILTER (ok = 0) AS bad, CAST((2 * count(*) FILTER (ok = n) + count(*) FILTER (ok > 0 AND ok < n)) * 50 // count(*) AS BIGINT) AS health FROM t")
def quick_scan_summary(spark, sf):
    t = sectors(spark, sf).groupBy("track").agg(F.count("*").alias("n"), F.count_if("crc_ok").alias("ok"))
    good, half = F.count_if(F.col("ok") == F.col("n")), F.count_if((F.col("ok") > 0) & (F.col("ok") < F.col("n")))
    return t.agg(F.count("*").alias("tracks"), good.alias("good"), half.alias("degraded"), F.count_if(F.col("ok") == 0).alias("bad"), F.floor((good * 2 + half) * 50 / F.count("*")).alias("health"))
