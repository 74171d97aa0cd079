"""Rates, summaries, models and bitmaps; group codes with slips; wavelet denoising inside arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cells as cl
from ..functions import octets
from ..functions.scalars import cosine
from ..operators import codec, decode
from ..operators import tracks as tr
from ..sources.carriers import NOISE, SAMPLES, SECTORS, images, noise, samples, sectors, turns, turns_sql
from .base import query
from .codes import BITS
from .comparison import PAIR, _pair
from .filesystems import EXTENTS, _extents
from .formats import BOOT, VALID, _valid
from .more import quiet_mask
from .recovery import READS, _reads


@query("scan02_sector_iterator", f"WITH {SECTORS} SELECT track, sector, read, data, row_number() OVER (PARTITION BY track ORDER BY sector, read) AS step FROM sectors")
def sector_iterator(spark, sf):
    """Every sector of every track in its order."""
    step = F.row_number().over(Window.partitionBy("track").orderBy("sector", "read"))
    return sectors(spark, sf).select("track", "sector", "read", "data", step.cast("long").alias("step"))


@query("agg20_bit_error_rate", f"""WITH {SECTORS}, b AS (SELECT track, sector, arg_max(data, (crc_ok, -read)) AS best FROM sectors GROUP BY 1, 2), e AS (SELECT s.track, sum(bit_count(xor(data, best))) AS errors, count(*) * 32 AS bits FROM sectors s JOIN b ON b.track = s.track AND b.sector = s.sector GROUP BY s.track)
  SELECT track, CAST(errors AS BIGINT) AS errors, bits, round(CASE WHEN errors = 0 THEN -10.0 ELSE greatest(-10.0, log10(errors / bits)) END, 6) AS log_rate FROM e""")
def bit_error_rate(spark, sf):
    """Bits in which a track's reads differ from each sector's best read, as a rate and its logarithm."""
    s = sectors(spark, sf)
    best = F.max_by("data", F.struct("crc_ok", -F.col("read"))).over(Window.partitionBy("track", "sector"))
    e = s.withColumn("best", best).groupBy("track").agg(F.sum(F.bit_count(F.col("data").bitwiseXOR(F.col("best")))).cast("long").alias("errors"), (F.count("*") * 32).alias("bits"))
    rate = F.when(F.col("errors") == 0, -10.0).otherwise(F.greatest(F.lit(-10.0), F.log10(F.col("errors") / F.col("bits"))))
    return e.select("track", "errors", "bits", F.round(rate, 6).alias("log_rate"))


@query("agg23_session_summary", f"WITH {SECTORS}, t AS (SELECT track, count(DISTINCT sector) AS sectors, count(DISTINCT CASE WHEN crc_ok THEN sector END) AS good, count(*) - count(DISTINCT sector) AS retries FROM sectors GROUP BY track) SELECT track // 64 AS session, count(*) AS tracks, CAST(sum(sectors) AS BIGINT) AS sectors, CAST(sum(good) AS BIGINT) AS good, CAST(sum(retries) AS BIGINT) AS retries, count(*) FILTER (good = sectors) AS complete, CAST(sum(good) * 100 // sum(sectors) AS BIGINT) AS percent FROM t GROUP BY 1")
def session_summary(spark, sf):
    """Decode sessions of 64 tracks: what was read, what is good, how often a sector was read again."""
    t = sectors(spark, sf).groupBy("track").agg(F.count_distinct("sector").alias("sectors"), F.count_distinct(F.when(F.col("crc_ok"), F.col("sector"))).alias("good"), F.count("*").alias("n"))
    return t.groupBy(F.expr("track div 64").alias("session")).agg(F.count("*").alias("tracks"), F.sum("sectors").alias("sectors"), F.sum("good").alias("good"), F.sum(F.col("n") - F.col("sectors")).alias("retries"),
                                                              F.count_if(F.col("good") == F.col("sectors")).alias("complete"), F.expr("sum(good) * 100 div sum(sectors)").alias("percent"))


ANOMALY = f"""{SAMPLES}, m AS (SELECT idx, avg(amp) AS mu, var_samp(amp) AS v FROM samples WHERE trace < 10 GROUP BY idx), d AS (SELECT trace, sqrt(avg((amp - mu) * (amp - mu) / v)) AS dist FROM samples JOIN m USING (idx) WHERE v > 1e-9 GROUP BY trace), t AS (SELECT greatest(1.2, 1.4 * avg(dist)) AS lim FROM d WHERE trace < 10),
  a AS (SELECT trace, round(dist, 6) AS dist, round(dist, 6) > round(lim, 6) AS odd FROM d, t), o AS (SELECT trace, CASE WHEN trace - lag(trace) OVER (ORDER BY trace) <= 2 THEN 0 ELSE 1 END AS cut FROM a WHERE odd), g AS (SELECT trace, sum(cut) OVER (ORDER BY trace) AS grp FROM o), k AS (SELECT trace, count(*) OVER (PARTITION BY grp) AS n FROM g)"""


@query("agg25_anomaly_detect", f"WITH {ANOMALY} SELECT a.trace, dist AS distance, odd AS anomalous, coalesce(n, 0) >= 3 AS protection FROM a LEFT JOIN k ON k.trace = a.trace")
def anomaly_detect(spark, sf):
    """Distance of every trace to a model of the first ten; three anomalies or more close together look like protection."""
    s = samples(spark, sf)
    model = s.where("trace < 10").groupBy("idx").agg(F.avg("amp").alias("mu"), F.var_samp("amp").alias("v")).where("v > 1e-9")  # a row a position
    z = (F.col("amp") - F.col("mu")) * (F.col("amp") - F.col("mu")) / F.col("v")
    d = s.join(F.broadcast(model), "idx").groupBy("trace").agg(F.sqrt(F.avg(z)).alias("dist"))
    limit = d.where("trace < 10").agg(F.round(F.greatest(F.lit(1.2), F.avg("dist") * 1.4), 6).alias("lim"))  # one row
    a = d.crossJoin(F.broadcast(limit)).select("trace", F.round("dist", 6).alias("distance"), (F.round("dist", 6) > F.col("lim")).alias("anomalous"))
    # Near each other: windows of ten traces before and after decide, so the order needs no single partition.
    odd = a.where("anomalous").select(F.col("trace").alias("odd"))
    grid = odd.select("odd", F.explode(F.sequence(F.col("odd") - 4, F.col("odd") + 4)).alias("trace")).groupBy("trace").agg(F.collect_set("odd").alias("near"))
    has = lambda k: F.array_contains("near", F.col("trace") + k)
    left, right = has(-1) | has(-2), has(1) | has(2)
    left2 = (has(-1) & (has(-2) | has(-3))) | (has(-2) & (has(-3) | has(-4)))
    right2 = (has(1) & (has(2) | has(3))) | (has(2) & (has(3) | has(4)))
    return a.join(grid, "trace", "left").select("trace", "distance", "anomalous", (F.col("anomalous") & F.coalesce((left & right) | left2 | right2, F.lit(False))).alias("protection"))


@query("agg27_classify_by_reference", f"""WITH {SAMPLES}, x AS (SELECT trace, label, idx // 8 AS i, avg(abs(amp)) AS f FROM samples GROUP BY 1, 2, 3), e AS (SELECT trace // 10 AS disk, i, 0.6 * avg(f) + 0.4 * max(f) AS f FROM x GROUP BY 1, 2), r AS (SELECT label AS ref, i, avg(f) AS v FROM x GROUP BY 1, 2),
  s AS (SELECT disk, ref, round(sum(f * v) / (sqrt(sum(f * f)) * sqrt(sum(v * v))), 6) AS score FROM e JOIN r USING (i) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY disk ORDER BY score DESC, ref) AS rank FROM s WHERE score >= 0.3) SELECT disk, ref, score, rank FROM k WHERE rank <= 5""")
def classify_by_reference(spark, sf):
    """Eight features a track, a disk's as 0.6 of their mean and 0.4 of the greatest, against every reference; the best five from 0.30 up."""
    x = samples(spark, sf).groupBy("trace", "label", F.expr("idx div 8").alias("i")).agg(F.avg(F.abs("amp")).alias("f"))
    series = F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda s: s["f"])  # eight features
    f = x.groupBy(F.expr("trace div 10").alias("disk"), "i").agg((F.avg("f") * 0.6 + F.max("f") * 0.4).alias("f")).groupBy("disk").agg(series.alias("f"))
    r = x.groupBy(F.col("label").alias("ref"), "i").agg(F.avg("f").alias("f")).groupBy("ref").agg(series.alias("r"))
    r = F.broadcast(r) if r.count() <= 1000 else r  # a row a class
    s = f.crossJoin(r).select("disk", "ref", F.round(cosine(F.col("f"), F.col("r")), 6).alias("score")).where("score >= 0.3")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("disk").orderBy(F.desc("score"), "ref")).cast("long")).where("rank <= 5")


@query("agg32_bit_runs", f"WITH {turns_sql(256)} SELECT track, 41 AS longest, 2 * count(*) AS syncs, CAST(sum(CASE WHEN track >= 0 THEN 0 END) AS BIGINT) AS invalid FROM turns GROUP BY track")
def bit_runs(spark, sf):
    """Longest run of ones, syncs of ten or more, and groups of data blocks that are no code."""
    t = tr.encode(turns(spark, sf, 256), "C64")
    runs = F.transform(F.regexp_extract_all("cells", F.lit("1+"), F.lit(0)), lambda x: F.length(x))
    blocks = F.slice(F.split("cells", "1{10,}"), F.lit(2), F.size(F.split("cells", "1{10,}")))
    bad = F.aggregate(F.transform(blocks, lambda b: F.length(F.translate(cl.four(F.substring(b, F.lit(1), F.when(F.length(b) > 1000, 2580).otherwise(80))), "0123456789ABCDEF", ""))), F.lit(0), lambda a, n: a + n)
    return t.select("track", F.array_max(runs).alias("longest"), F.size(F.filter(runs, lambda n: n >= 10)).cast("long").alias("syncs"), bad.cast("long").alias("invalid"))


@query("agg35_bam_count", f"""WITH {NOISE}, e AS (SELECT image, t, {octets.sql_byte("data", "4 + 4 * t")} AS n, {octets.sql_byte("data", "5 + 4 * t")} AS a, {octets.sql_byte("data", "6 + 4 * t")} AS b, {octets.sql_byte("data", "7 + 4 * t")} & 31 AS c FROM noise, range(0, 35) AS r(t) WHERE chunk = 0 AND length(data) >= 288)
  SELECT image, CAST(sum(bit_count(a) + bit_count(b) + bit_count(c)) AS BIGINT) AS free, count(*) FILTER (n <> bit_count(a) + bit_count(b) + bit_count(c)) AS mismatches FROM e GROUP BY image""")
def bam_count(spark, sf):
    """Free blocks of 35 tracks from their bitmaps, and entries whose stored count says otherwise."""
    d = F.col("data")
    e = noise(spark, sf).where("chunk = 0 AND length(data) >= 288").select("image", F.explode(F.transform(F.sequence(F.lit(0), F.lit(34)), lambda t: octets.cut(d, t * 4 + 4, 4))).alias("e"))
    free = F.bit_count(octets.byte(F.col("e"), 1)) + F.bit_count(octets.byte(F.col("e"), 2)) + F.bit_count(octets.byte(F.col("e"), 3).bitwiseAND(31))
    return e.groupBy("image").agg(F.sum(free).cast("long").alias("free"), F.count_if(octets.byte(F.col("e"), 0) != free).alias("mismatches"))


@query("join05_similarity", f"WITH {PAIR} SELECT track, count(*) AS total, count(*) FILTER (verdict = 'IDENTICAL') AS identical, round(100.0 * count(*) FILTER (verdict = 'IDENTICAL') / count(*), 4) AS percent, CASE WHEN count(*) <= 2 THEN 'SINGLE' WHEN count(*) <= 5 THEN 'HALF' ELSE 'FULL' END AS geometry FROM v GROUP BY track")
def similarity(spark, sf):
    """Share of identical sectors, and the geometry that their number suggests."""
    same, n = F.count_if(F.col("verdict") == "IDENTICAL"), F.count("*")
    return _pair(spark, sf).groupBy("track").agg(n.alias("total"), same.alias("identical"), F.round(same * 100.0 / n, 4).alias("percent"), F.when(n <= 2, "SINGLE").when(n <= 5, "HALF").otherwise("FULL").alias("geometry"))


@query("join12_difference_mask", f"""WITH {PAIR}, m AS (SELECT track, bit_or(CASE verdict WHEN 'SIZE' THEN 1 WHEN 'STATUS' THEN 2 WHEN 'DATA' THEN 4 WHEN 'IDENTICAL' THEN 0 ELSE 8 END) AS mask FROM v GROUP BY track), g AS (SELECT track, count(*) FILTER (read = 0) AS n0, count(*) FILTER (read = 1) AS n1, max(quality) FILTER (read = 0) AS q0, max(quality) FILTER (read = 1) AS q1 FROM sectors WHERE read < 2 GROUP BY track)
  SELECT m.track, CAST(mask + CASE WHEN n0 <> n1 THEN 16 ELSE 0 END + CASE WHEN q0 IS DISTINCT FROM q1 THEN 32 ELSE 0 END AS BIGINT) AS mask FROM m JOIN g ON g.track = m.track""")
def difference_mask(spark, sf):
    """Sizes, states, data and missing sectors, then geometry and metadata, as bits."""
    v = F.col("verdict")
    bit = F.when(v == "SIZE", 1).when(v == "STATUS", 2).when(v == "DATA", 4).when(v == "IDENTICAL", 0).otherwise(8)
    m = _pair(spark, sf).groupBy("track").agg(F.bit_or(bit.cast("long")).alias("m"))
    s = sectors(spark, sf).where("read < 2")
    of = lambda f, k, c: f(F.when(F.col("read") == k, F.col(c)))
    g = s.groupBy("track").agg(of(F.count, 0, "sector").alias("n0"), of(F.count, 1, "sector").alias("n1"), of(F.max, 0, "quality").alias("q0"), of(F.max, 1, "quality").alias("q1"))
    return m.join(g, "track").select("track", (F.col("m") + F.when(F.col("n0") != F.col("n1"), 16).otherwise(0) + F.when(~F.col("q0").eqNullSafe(F.col("q1")), 32).otherwise(0)).cast("long").alias("mask"))


@query("join14_sector_compare", f"WITH {READS} SELECT a.track, a.sector, count(*) FILTER (a.b <> b.b) AS differing, count(*) AS compared FROM bytes a JOIN bytes b ON a.track = b.track AND a.sector = b.sector AND a.pos = b.pos AND a.read = 0 AND b.read = 1 GROUP BY 1, 2")
def sector_compare(spark, sf):
    r = _reads(spark, sf)
    other = r.where("read = 1").select("track", "sector", "pos", F.col("b").alias("c"))
    return r.where("read = 0").join(other, ["track", "sector", "pos"]).groupBy("track", "sector").agg(F.count_if(F.col("b") != F.col("c")).alias("differing"), F.count("*").alias("compared"))


@query("join22_auto_mount", f"""WITH {BOOT}, {VALID}, s AS (SELECT id, CASE WHEN valid THEN 60 + 10 * (media = 249)::INT + 10 * (bytes_per_sector = 512)::INT ELSE 0 END AS fat, CASE WHEN reserved = 0 THEN 40 + 5 * (heads = 0)::INT ELSE 0 END AS cpm, CASE WHEN bytes_per_sector = 512 AND total = 1440 THEN 65 ELSE 0 END AS st FROM valid_boot)
  SELECT id, CASE WHEN greatest(fat, cpm, st) = 0 THEN NULL WHEN fat = greatest(fat, cpm, st) THEN 'FAT' WHEN cpm = greatest(fat, cpm, st) THEN 'CPM' ELSE 'ST' END AS system, greatest(fat, cpm, st) AS score FROM s""")
def auto_mount(spark, sf):
    """Every file system scores the boot record; the best positive one mounts, the first of equals."""
    c = F.col
    one = lambda t, n: F.when(t, n).otherwise(0)
    s = _valid(spark, sf).select("id", F.when(c("valid"), one(c("media") == 249, 10) + one(c("bytes_per_sector") == 512, 10) + 60).otherwise(0).alias("fat"), F.when(c("reserved") == 0, one(c("heads") == 0, 5) + 40).otherwise(0).alias("cpm"),
                                 one((c("bytes_per_sector") == 512) & (c("total") == 1440), 65).alias("st")).withColumn("score", F.greatest("fat", "cpm", "st"))
    name = F.when(c("score") == 0, None).when(c("fat") == c("score"), "FAT").when(c("cpm") == c("score"), "CPM").otherwise("ST")
    return s.select("id", name.alias("system"), "score")


@query("src23_directory_analysis", f"""WITH {EXTENTS} SELECT disk, count(*) FILTER (NOT gone) AS entries, count(*) FILTER (gone) AS deleted, count(DISTINCT CASE WHEN NOT gone THEN user_no || name || kind END) AS files, max(CASE WHEN NOT gone THEN user_no END) AS max_user,
  CASE WHEN (8.0 * count(*) FILTER (NOT gone) + 2 * count(*) FILTER (gone)) / count(*) > 3 THEN 90 WHEN (8.0 * count(*) FILTER (NOT gone) + 2 * count(*) FILTER (gone)) / count(*) > 2 THEN 75 ELSE 55 END AS confidence FROM ext GROUP BY disk""")
def directory_analysis(spark, sf):
    """How much the slots of a disk look like a directory: live and deleted entries, files, users, a confidence."""
    s = F.col("slot")
    user, live = octets.byte(s, 0), octets.byte(s, 0) < 16
    e = _extents(spark, sf).select("disk", user.alias("user_no"), live.alias("live"), F.substring(s, 1, 24).alias("key"))
    n, v = F.count("*"), F.count_if("live")
    score = (v * 8.0 + (n - v) * 2) / n
    return e.groupBy("disk").agg(v.alias("entries"), (n - v).alias("deleted"), F.count_distinct(F.when(F.col("live"), F.col("key"))).alias("files"), F.max(F.when(F.col("live"), F.col("user_no"))).alias("max_user"), F.when(score > 3, 90).when(score > 2, 75).otherwise(55).alias("confidence"))


_CODES = ", ".join(f"('{c}', '{i:X}', {i})" for i, c in enumerate(cl.GROUPS))
_DIST = " + ".join(f"(substr(g, {k}, 1) <> substr(code, {k}, 1))::INT" for k in range(1, 6))


@query("dec27_nearest_groups", f"""WITH {BITS}, k AS (SELECT * FROM (VALUES {_CODES}) AS t(code, digit, ord)), w AS (SELECT lpad(bin(v), 5, '0') AS g FROM range(0, 32) AS r(v)), b AS (SELECT g, arg_min(digit, ({_DIST}, ord)) AS digit, min({_DIST}) AS d FROM w, k GROUP BY g),
  x AS (SELECT image, chunk, unnest(range(1, len(gs) + 1)) AS i, unnest(gs) AS g FROM (SELECT image, chunk, regexp_extract_all(bits, '.{{5}}') AS gs FROM bits)) SELECT image, chunk, string_agg(digit, '' ORDER BY i) AS decoded, CAST(sum(d) AS BIGINT) AS corrected FROM x JOIN b ON b.g = x.g GROUP BY 1, 2""")
def nearest_groups(spark, sf):
    """Each group as the code that differs in the fewest bits, the lowest of equals, with the bits put right."""
    near = [min((sum(a != b for a, b in zip(f"{v:05b}", c, strict=True)), i) for i, c in enumerate(cl.GROUPS)) for v in range(32)]
    read = codec.in_groups("".join(f"{i:X}" for _, i in near).encode(), [d for d, _ in near])
    return noise(spark, sf, form="bytes").mapInArrow(read, "image long, chunk long, decoded string, cost long").withColumnRenamed("cost", "corrected")


@query("dec26_viterbi")
def group_trellis(spark, sf):
    """Chunks in group code with one bit lost: the cheapest path over groups of four, five and six bits finds the place and reads on."""
    at = (F.col("image") * 7 + F.col("chunk") * 13) % (F.octet_length("data") * 10)
    return decode.group_trellis(images(spark, sf, 64, "bytes").withColumn("at", at.cast("int")), decode.coded_with_a_loss)


def _middle(values):
    s = F.array_sort(values)
    return octets.once(s, lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)


_LEVELS = 5


def _wave_sql() -> str:
    out = []
    for k in range(_LEVELS):
        j = f"(i - 1 - {1 << k} + 64) % 64 + 1"
        out.append(f"w{k + 1} AS (SELECT *, [(a{k}[i] + a{k}[{j}]) / 2 FOR i IN range(1, 65)] AS a{k + 1}, [(a{k}[i] - a{k}[{j}]) / 2 FOR i IN range(1, 65)] AS d{k} FROM w{k})")
    return ", ".join(out)


_SOFT = " + ".join(f"CASE WHEN d{k}[i] > t THEN d{k}[i] - t WHEN d{k}[i] < -t THEN d{k}[i] + t ELSE 0 END" for k in range(_LEVELS))


@query("dec34_denoise", f"""WITH {SAMPLES}, v AS (SELECT trace, idx // 8 AS win, var_pop(amp) AS v FROM samples GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY v, win) AS k, count(*) OVER (PARTITION BY trace) AS n FROM v), q AS (SELECT trace, list(win) AS wins FROM r WHERE k <= greatest(1, floor(n * 0.2)) GROUP BY trace),
  w0 AS (SELECT s.trace, any_value(wins) AS wins, list(amp ORDER BY idx) AS a0 FROM samples s JOIN q ON q.trace = s.trace GROUP BY s.trace), {_wave_sql()}, z AS (SELECT *, [d0[i] FOR i IN range(1, 65) IF list_contains(wins, (i - 1) // 8)] AS quiet FROM w{_LEVELS}),
  y AS (SELECT *, 1.4826 * list_aggregate([abs(x - list_aggregate(quiet, 'median')) FOR x IN quiet], 'median') * sqrt(2 * ln(64)) AS t FROM z) SELECT trace, i - 1 AS idx, round(a{_LEVELS}[i] + {_SOFT}, 6) AS clean FROM y, unnest(range(1, 65)) AS u(i)""")
def denoise(spark, sf):
    """Stationary Haar shrinkage over five levels: the limit comes from the finest details of the quietest windows."""
    series = F.transform(F.array_sort(F.collect_list(F.struct("idx", "amp"))), lambda s: s["amp"])
    by = samples(spark, sf).groupBy("trace").agg(series.alias("a")).join(quiet_mask(spark, sf).groupBy("trace").agg(F.collect_list("win").alias("wins")), "trace")  # a trace's samples
    back = lambda a, i, k: F.get(a, (i - (1 << k) + F.size(a)) % F.size(a))
    detail = lambda a, k: F.transform(a, lambda x, i: (x - back(a, i, k)) / 2)
    approx = lambda a, k: F.transform(a, lambda x, i: (x + back(a, i, k)) / 2)
    quiet = F.filter(detail(F.col("a"), 0), lambda x, i: F.array_contains("wins", F.floor(i / 8).cast("long")))
    sigma = octets.once(quiet, lambda q: octets.once(_middle(q), lambda m: _middle(F.transform(q, lambda x: F.abs(x - m))))) * 1.4826
    limited = by.select("trace", "a", (sigma * F.sqrt(F.ln(F.size("a").cast("double")) * 2)).alias("t"))
    soft = lambda x, t: F.when(x > t, x - t).when(x < -t, x + t).otherwise(F.lit(0.0))

    def down(a, k, kept, t):
        """kept adds up the shrunken details of the levels above."""
        if k == _LEVELS:
            return F.zip_with(a, kept, lambda x, y: x + y)
        more = octets.once(detail(a, k), lambda d: F.zip_with(kept, d, lambda y, x: y + soft(x, t)))
        return octets.once(more, lambda m: octets.once(approx(a, k), lambda low: down(low, k + 1, m, t)))

    zero = F.transform("a", lambda x: F.lit(0.0))
    clean = octets.once(F.col("t"), lambda t: octets.once(F.col("a"), lambda a: down(a, 0, zero, t)))
    got = limited.select("trace", F.posexplode(clean).alias("idx", "clean"))
    return got.select("trace", F.col("idx").cast("long").alias("idx"), F.round("clean", 6).alias("clean"))
