"""Copy-protection rules over tracks: byte patterns, counts, timing and repeated reads. Tracks are chunks of mixed document bytes, or pulses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import octets
from ..operators import compare
from ..operators import features as ft
from ..operators import signatures as sg
from ..operators import tracks as tr
from ..sources.carriers import IMAGES, NOISE, PULSES, SECTORS, images, noise, pulses, sectors, table, turns, turns_sql
from ..sources.storage import stored
from .base import query
from .codes import CHECK_CELL

#: Tracks with a planted pattern: zeros and fillers by the image's number, in front of the chunk's own bytes.
PLANTED = f"""{NOISE}, tracks AS (SELECT image, chunk, CASE image % 4 WHEN 0 THEN repeat('FF', CAST(18 + image % 9 AS INT)) || '55' || repeat('7B', CAST(160 + image % 10 AS INT)) WHEN 1 THEN '6446644664466446644664466446' WHEN 2 THEN '49494949494949494949' ELSE '' END || data AS data FROM noise)"""


def _tracks(spark, sf):
    i = F.col("image")
    rapid = F.concat(F.repeat(F.lit("FF"), (i % 9 + 18).cast("int")), F.lit("55"), F.repeat(F.lit("7B"), (i % 10 + 160).cast("int")))
    plant = F.when(i % 4 == 0, rapid).when(i % 4 == 1, "6446" * 7).when(i % 4 == 2, "49" * 10).otherwise("")
    return noise(spark, sf).select("image", "chunk", F.concat(plant, "data").alias("data"))


def _count(hexed, byte: str):
    """How often a byte value stands in a track."""
    return F.regexp_count(hexed, F.lit(rf"\G(?:..)*?{byte}")).cast("long")


def _count_sql(byte: str) -> str:
    return f"len([b FOR b IN regexp_extract_all(data, '..') IF b = '{byte}'])"


_RAPID = "(?:FF){21,}55(?:7B){164,}"


@query("prot06_pattern_track", f"WITH {PLANTED} SELECT image, chunk, CAST(length(regexp_extract(data, '^((?:..)*?){_RAPID}', 1)) // 2 AS BIGINT) AS start_byte, 95 AS confidence FROM tracks WHERE length(data) >= 400 AND regexp_matches(data, '^(?:..)*?{_RAPID}')")
def pattern_track(spark, sf):
    """21 sync bytes or more, 55, 164 fillers or more, in a track of 200 bytes at least: the first place."""
    start = F.expr(f"cast(length(regexp_extract(data, '^((?:..)*?){_RAPID}', 1)) / 2 AS long)")
    return _tracks(spark, sf).where((F.length("data") >= 400) & F.col("data").rlike(f"^(?:..)*?{_RAPID}")).select("image", "chunk", start.alias("start_byte"), F.lit(95).alias("confidence"))


_MARKERS = "(?:6446|4664|4E46)"


@query("prot05_marker", f"WITH {PLANTED} SELECT image, chunk, CAST(length(regexp_extract(data, '^((?:..)*?){_MARKERS}', 1)) // 2 AS BIGINT) AS start_byte, 95 AS confidence FROM tracks WHERE regexp_matches(data, '^(?:..)*?{_MARKERS}')")
def marker(spark, sf):
    """The first marker pattern at a byte border; the confidence is fixed."""
    start = F.expr(f"cast(length(regexp_extract(data, '^((?:..)*?){_MARKERS}', 1)) / 2 AS long)")
    return _tracks(spark, sf).where(F.col("data").rlike(f"^(?:..)*?{_MARKERS}")).select("image", "chunk", start.alias("start_byte"), F.lit(95).alias("confidence"))


C64 = f"""{PLANTED}, c AS (SELECT image, chunk % 42 AS track, data, {_count_sql('64')} AS n64, {_count_sql('46')} AS n46, {_count_sql('49')} AS n49, {_count_sql('7B')} AS n7b, {_count_sql('FF')} AS nff, length(data) // 2 AS size FROM tracks),
  hits AS (SELECT image, track, unnest([CASE WHEN n64 > 5 AND n46 > 5 THEN {{'rule': 'VMAX_2', 'conf': 85}} WHEN n49 > 8 THEN {{'rule': 'VMAX_3', 'conf': 80}} END, CASE WHEN n7b > 100 THEN {{'rule': 'RAPIDLOK', 'conf': 90}} END, CASE WHEN size > 400 THEN {{'rule': 'LONG_TRACK', 'conf': 60}} END, CASE WHEN track > 35 AND size >= 100 THEN {{'rule': 'EXTRA_TRACK', 'conf': 50}} END, CASE WHEN nff > 20 THEN {{'rule': 'CUSTOM_SYNC', 'conf': 55}} END]) AS h FROM c)"""


def _c64(spark, sf):
    d = F.col("data")
    c = _tracks(spark, sf).select("image", (F.col("chunk") % 42).alias("track"), *[_count(d, b).alias(f"n{b}") for b in ("64", "46", "49", "7B", "FF")], F.floor(F.length(d) / 2).alias("size"))
    hit = lambda rule, conf: F.struct(F.lit(rule).alias("rule"), F.lit(conf).alias("conf"))
    n = lambda b: F.col(f"n{b}")
    rules = [F.when((n("64") > 5) & (n("46") > 5), hit("VMAX_2", 85)).when(n("49") > 8, hit("VMAX_3", 80)), F.when(n("7B") > 100, hit("RAPIDLOK", 90)), F.when(F.col("size") > 400, hit("LONG_TRACK", 60)),
             F.when((F.col("track") > 35) & (F.col("size") >= 100), hit("EXTRA_TRACK", 50)), F.when(n("FF") > 20, hit("CUSTOM_SYNC", 55))]
    return c.select("image", "track", F.explode(F.array_compact(F.array(*rules))).alias("h")).select("image", "track", "h.*")


@query("prot03_c64_rules", f"WITH {C64} SELECT image, track, h.rule AS rule, h.conf AS confidence FROM hits WHERE h IS NOT NULL")
def c64_rules(spark, sf):
    """Counts of marker bytes, sizes and track numbers, a row for each rule that a track meets."""
    return _c64(spark, sf).withColumnRenamed("conf", "confidence")


@query("prot04_scan_disk", f"WITH {C64} SELECT image, h.rule AS rule, count(*) AS tracks, min(track) AS first_track, max(h.conf) AS confidence FROM hits WHERE h IS NOT NULL GROUP BY 1, 2")
def scan_disk(spark, sf):
    """All tracks of a disk against all rules, a row for each rule found."""
    return _c64(spark, sf).groupBy("image", "rule").agg(F.count("*").alias("tracks"), F.min("track").alias("first_track"), F.max("conf").alias("confidence"))


# Fixed values of this example: machines with the encoding of their tracks.
_MACHINES = [("C64", "C64"), ("APPLE_II", "APPLE"), ("AMIGA", "AMIGA"), ("ATARI_ST", "MFM"), ("PC", "MFM"), ("MSX", "MFM"), ("CPC", "MFM"), ("PC98", "MFM"), ("ATARI_8", "FM"), ("BBC", "FM")]
# Fixed values of this example: rules by their terms (kind, feature, least value); a machine's own confidence is the rule's plus its place.
_RULES = [("DUPLICATE_ID", 60, [("all", "duplicates", 1), ("none", "bad", 1)]), ("BAD_CHECKS", 75, [("all", "bad", 1), ("any", "duplicates", 1), ("any", "bad", 2)]), ("LONG_GAP", 65, [("all", "gap", 12000), ("none", "ones", 300)]), ("LONG_SYNC", 80, [("all", "ones", 300)])]
_TERMS = [(m, rule, conf + k, kind, feature, least) for k, (m, _) in enumerate(_MACHINES) for rule, conf, terms in _RULES for kind, feature, least in terms]
#: Conversations are tracks of ten machines; by their number they hold nothing, a sector twice, bad checks, a long gap, a long sync, or a sector twice with bad checks.
_SECTORS_OF = " UNION ALL ".join(f"SELECT track, sector FROM t{i} WHERE track % 10 IN ({', '.join(str(k) for k, (_, x) in enumerate(_MACHINES) if x == e)})" for i, e in enumerate(tr.ENCODINGS))
TRAPS = ", ".join(turns_sql(tr.SIZES[e], f"t{i}") for i, e in enumerate(tr.ENCODINGS)) + f""", u AS ({_SECTORS_OF}), m AS (SELECT track, count(*) AS n, track % 10 AS machine, track // 10 % 6 AS trap, count(*) FILTER (sector % 2 = 0) AS even FROM u GROUP BY track),
  f AS (SELECT track, {[m for m, _ in _MACHINES]}[CAST(1 + machine AS BIGINT)] AS machine, machine AS place, CASE WHEN trap IN (1, 5) THEN 1 ELSE 0 END AS duplicates, CASE WHEN trap IN (2, 5) THEN even ELSE 0 END AS bad, CASE WHEN trap = 3 THEN 12000 ELSE 0 END AS gap, CASE WHEN trap = 4 THEN 400 ELSE 0 END AS ones FROM m)"""


def _trapped(spark, sf, encoding, machines):
    """track, cells of the machines' tracks, written in their encoding with what their number puts in."""
    machine, trap = F.col("track") % 10, F.floor(F.col("track") / 10) % 6
    t = turns(spark, sf, tr.SIZES[encoding]).where(machine.isin(machines))
    first = F.min("sector").over(Window.partitionBy("track"))
    twice = t.withColumn("first", first).where((trap.isin(1, 5)) & (F.col("sector") == F.col("first"))).drop("first")
    # The copy of a sector is whole, so the number of bad checks is that of the sectors.
    bad = F.when(trap.isin(2, 5) & (F.col("sector") % 2 == 0) & ~F.col("copy"), CHECK_CELL[encoding])
    both = t.withColumn("copy", F.lit(False)).unionByName(twice.withColumn("copy", F.lit(True)))
    made = tr.encode(both, encoding, bad)
    return made.select("track", F.concat(F.when(trap == 4, "1" * 400).otherwise(""), "cells", F.when(trap == 3, "10" * 6000).otherwise("")).alias("cells"))


@query("prot01_unified_rules", f"""WITH {TRAPS}, h AS (SELECT track, unnest([CASE WHEN duplicates >= 1 AND bad < 1 THEN {{'rule': 'DUPLICATE_ID', 'conf': 60 + place}} END, CASE WHEN bad >= 1 AND (duplicates >= 1 OR bad >= 2) THEN {{'rule': 'BAD_CHECKS', 'conf': 75 + place}} END,
    CASE WHEN gap >= 12000 AND ones < 300 THEN {{'rule': 'LONG_GAP', 'conf': 65 + place}} END, CASE WHEN ones >= 300 THEN {{'rule': 'LONG_SYNC', 'conf': 80 + place}} END]) AS x FROM f), g AS (SELECT track, count(x) AS hits, arg_max(x.rule, x.conf) FILTER (x IS NOT NULL) AS primary_hit, max(x.conf) AS confidence FROM h GROUP BY track)
  SELECT f.track, machine, hits, primary_hit, CAST(coalesce(confidence, 0) AS INTEGER) AS confidence FROM f JOIN g ON g.track = f.track""")
def unified_rules(spark, sf):
    """Ten machines' rules, as a table of terms, against what five decoders find on their tracks; the surest hit is the track's."""
    every = None
    for encoding in tr.ENCODINGS:
        mine = [k for k, (_, e) in enumerate(_MACHINES) if e == encoding]
        part = ft.features(stored(_trapped(spark, sf, encoding, mine), "tracks"), encoding)
        every = part if every is None else every.unionByName(part)
    table_ = every.withColumn("machine", F.get(F.array(*[F.lit(m) for m, _ in _MACHINES]), (F.col("track") % 10).cast("int")))
    rules = F.broadcast(spark.createDataFrame(_TERMS, "machine string, rule string, conf int, kind string, feature string, least long"))  # a row a term
    h = ft.hits(table_, rules, "machine").groupBy("track").agg(F.count("*").alias("hits"), F.max_by("rule", "conf").alias("primary_hit"), F.max("conf").alias("confidence"))
    return table_.select("track", "machine").join(h, "track", "left").na.fill(0, ["hits", "confidence"])


def _register(seed, n: int):
    """n bytes of a 23-bit register with taps 22 and 17: its upper eight bits before each step."""
    def step(a, _):
        s = a["s"]
        new = F.shiftright(s, 22).bitwiseXOR(F.shiftright(s, 17)).bitwiseAND(1)
        return F.struct(F.shiftleft(s, 1).bitwiseOR(new).bitwiseAND(0x7FFFFF).alias("s"), F.concat(a["out"], F.array(F.shiftright(s, 15))).alias("out"))

    return octets.once(seed, lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.struct(s.alias("s"), F.array().cast("array<long>").alias("out")), step)["out"])


def _seed(output):
    """The start of the register: its upper eight bits are the first byte, and each of the next fifteen bytes ends in one bit more."""
    low = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0).cast("long"), lambda a, k: a * 2 + F.get(output, k).bitwiseAND(1))
    return F.get(output, F.lit(0)) * 32768 + low


@query("prot08_seed_recover", "SELECT o_orderkey AS id, (o_orderkey * 7919 + 12345) & 8388607 AS seed FROM orders")
def seed_recover(spark, sf):
    """The register's start read off its output."""
    seed = (F.col("o_orderkey") * 7919 + 12345).bitwiseAND(0x7FFFFF)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _register(seed, 16).alias("bytes"))
    return o.select("id", _seed(F.col("bytes")).alias("seed"))


@query("prot07_register_track", f"""WITH {NOISE}, t AS (SELECT image, chunk, CASE WHEN image % 3 = 0 THEN '8914' WHEN image % 3 = 1 THEN '8A91' ELSE '1234' END AS sync, 100 + image * 13 % 50 AS ratio, (image * 7919 + chunk * 31) & 8388607 AS seed FROM noise)
  SELECT image, chunk, CASE WHEN image % 3 = 0 THEN 'STANDARD' ELSE 'OLD' END AS variant, CASE WHEN ratio BETWEEN 105 AND 140 THEN 40 ELSE 0 END + 30 + CASE WHEN image % 5 <> 4 THEN 30 ELSE 0 END AS confidence, CASE WHEN image % 5 <> 4 THEN seed END AS seed FROM t WHERE image % 3 < 2""")
def register_track(spark, sf):
    """Known sync words (30), timing off by a known share (40), and bytes that a shift register makes (30), with its start."""
    i = F.col("image")
    seed = (i * 7919 + F.col("chunk") * 31).bitwiseAND(0x7FFFFF)
    n = noise(spark, sf).select("image", "chunk", F.when(i % 3 == 0, "8914").when(i % 3 == 1, "8A91").otherwise("1234").alias("sync"), (i * 13 % 50 + 100).alias("ratio"), seed.alias("s0"))
    b = n.withColumn("bytes", _register(F.col("s0"), 20))
    b = b.withColumn("bytes", F.when(i % 5 == 4, F.transform("bytes", lambda x, k: F.when(k == 18, 255 - x).otherwise(x))).otherwise(F.col("bytes")))
    got = b.withColumn("guess", _seed(F.col("bytes")))
    fits = _register(F.col("guess"), 20) == F.col("bytes")  # the guess is run again and held against all the bytes
    v = got.withColumn("fits", fits).where("sync IN ('8914', '8A91')")
    conf = F.when(F.col("ratio").between(105, 140), 40).otherwise(0) + 30 + F.when(F.col("fits"), 30).otherwise(0)
    return v.select("image", "chunk", F.when(F.col("sync") == "8914", "STANDARD").otherwise("OLD").alias("variant"), conf.alias("confidence"), F.when(F.col("fits"), F.col("guess")).alias("seed"))


REGIONS = f"""{PULSES}, m AS (SELECT track, avg(dt) AS base FROM pulses GROUP BY track), r AS (SELECT p.track, idx, CASE WHEN avg(dt) OVER w > base * 1.08 THEN 'LONG' WHEN avg(dt) OVER w < base * 0.92 THEN 'SHORT' ELSE 'NORMAL' END AS kind, dt, base FROM pulses p JOIN m ON m.track = p.track WINDOW w AS (PARTITION BY p.track ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING)),
  g AS (SELECT *, idx - row_number() OVER (PARTITION BY track, kind ORDER BY idx) AS grp FROM r)"""


@query("prot09_timing_regions", f"WITH {REGIONS} SELECT track, kind, min(idx) AS first, count(*) AS length, round(avg(dt) / any_value(base), 6) AS ratio FROM g WHERE kind <> 'NORMAL' GROUP BY track, kind, grp HAVING count(*) >= 3")
def timing_regions(spark, sf):
    """Stretches whose timing lies off the track's mean, as long and short regions with their ratio."""
    from ..operators import windows as win

    w = Window.partitionBy("track")
    p = pulses(spark, sf).withColumns({"base": F.avg("dt").over(w), "local": F.avg("dt").over(w.orderBy("idx").rowsBetween(-3, 4))})
    kind = F.when(F.col("local") > F.col("base") * 1.08, "LONG").when(F.col("local") < F.col("base") * 0.92, "SHORT").otherwise("NORMAL")
    r = win.runs(p, ["track"], "idx", kind, F.round(F.avg("dt") / F.max("base"), 6).alias("ratio")).where("run_label <> 'NORMAL' AND length >= 3")
    return r.select("track", F.col("run_label").alias("kind"), "first", "length", "ratio")


@query("prot10_long_pattern", f"""WITH {PLANTED}, s AS (SELECT image, chunk, length(data) // 2 AS size, length(regexp_extract(data, '((?:FF)+)', 1)) // 2 AS fill, regexp_matches(data, '^(?:..)*?(?:4949){{3,}}') AS pattern FROM tracks) SELECT image, chunk, size, CASE WHEN pattern THEN 'PATTERN' WHEN fill >= 20 THEN 'FILLED' ELSE 'PLAIN' END AS kind, CASE WHEN pattern OR fill >= 20 THEN 90 ELSE 60 END AS confidence FROM s WHERE size > 258""")
def long_pattern(spark, sf):
    """Tracks longer than the medium allows, by what they are filled with."""
    d = F.col("data")
    fill = F.floor(F.length(F.regexp_extract(d, "((?:FF)+)", 1)) / 2)
    s = _tracks(spark, sf).select("image", "chunk", F.floor(F.length(d) / 2).alias("size"), fill.alias("fill"), d.rlike("^(?:..)*?(?:4949){3,}").alias("pattern")).where("size > 258")
    kind = F.when(F.col("pattern"), "PATTERN").when(F.col("fill") >= 20, "FILLED").otherwise("PLAIN")
    return s.select("image", "chunk", "size", kind.alias("kind"), F.when(F.col("pattern") | (F.col("fill") >= 20), 90).otherwise(60).alias("confidence"))


@query("prot11_fuzzy_sector", f"WITH {SECTORS}, v AS (SELECT track, sector, count(*) AS reads, count(DISTINCT data) AS kinds, count(*) FILTER (NOT crc_ok) AS bad FROM sectors GROUP BY 1, 2) SELECT track, count(*) FILTER (reads > 1 AND kinds = reads) AS fuzzy, bool_or(sector = 7 AND kinds > 1) AS at_home, count(*) FILTER (reads > 1 AND kinds = reads) >= 2 AS protected FROM v WHERE reads > 1 GROUP BY track")
def fuzzy_sector(spark, sf):
    """Sectors that never read the same twice, and whether the one that the scheme uses is among them."""
    v = sectors(spark, sf).groupBy("track", "sector").agg(F.count("*").alias("reads"), F.count_distinct("data").alias("kinds")).where("reads > 1")
    fuzzy = F.count_if(F.col("kinds") == F.col("reads"))
    return v.groupBy("track").agg(fuzzy.alias("fuzzy"), F.bool_or((F.col("sector") == 7) & (F.col("kinds") > 1)).alias("at_home"), (fuzzy >= 2).alias("protected"))


@query("prot12_align_auto", f"""WITH {PLANTED}, s AS (SELECT image, chunk, data, CASE WHEN regexp_matches(data, '^(?:..)*?{_RAPID}') THEN 'PATTERN' WHEN regexp_matches(data, '^(?:..)*?{_MARKERS}') THEN 'MARKER' WHEN regexp_matches(data, '^(?:..)*?FFFF') THEN 'SYNC' ELSE 'NONE' END AS how FROM tracks),
  o AS (SELECT *, CASE how WHEN 'PATTERN' THEN length(regexp_extract(data, '^((?:..)*?){_RAPID}', 1)) WHEN 'MARKER' THEN length(regexp_extract(data, '^((?:..)*?){_MARKERS}', 1)) WHEN 'SYNC' THEN length(regexp_extract(data, '^((?:..)*?)FFFF', 1)) ELSE 0 END AS n FROM s) SELECT image, chunk, how, CAST(n // 2 AS BIGINT) AS turned, md5(substr(data, CAST(n + 1 AS BIGINT)) || substr(data, 1, CAST(n AS BIGINT))) AS digest FROM o""")
def align_auto(spark, sf):
    """Each track turned so that it starts at the first of what is surest: a key pattern, a marker, a sync."""
    at = lambda p: F.expr(f"length(regexp_extract(data, '^((?:..)*?){p}', 1))")
    has = lambda p: F.col("data").rlike(f"^(?:..)*?{p}")
    how = F.when(has(_RAPID), "PATTERN").when(has(_MARKERS), "MARKER").when(has("FFFF"), "SYNC").otherwise("NONE")
    n = F.when(F.col("how") == "PATTERN", at(_RAPID)).when(F.col("how") == "MARKER", at(_MARKERS)).when(F.col("how") == "SYNC", at("FFFF")).otherwise(0)
    o = _tracks(spark, sf).withColumn("how", how).withColumn("n", n)
    return o.select("image", "chunk", "how", F.floor(F.col("n") / 2).alias("turned"), F.md5(F.concat(F.substring("data", F.col("n") + 1, F.length("data")), F.substring("data", F.lit(1), F.col("n")))).alias("digest"))


#: Chunks are tracks two half tracks apart; in every third image each odd one is the one before it with up to three bytes changed.
_FAT = f"""{IMAGES}, l AS (SELECT image, chunk, data, lag(data) OVER (PARTITION BY image ORDER BY chunk) AS before FROM images), tracks AS (SELECT image, chunk * 2 AS half, CASE WHEN image % 3 = 0 AND chunk % 2 = 1 THEN substr(repeat('00', 3), 1, CAST(2 * least(image % 4, length(before) // 2) AS INTEGER)) || substr(before, CAST(2 * least(image % 4, length(before) // 2) + 1 AS INTEGER)) ELSE data END AS data FROM l),
  p AS (SELECT a.image, a.half, a.data AS x, b.data AS y FROM tracks a JOIN tracks b ON b.image = a.image AND b.half = a.half + 2),
  d AS (SELECT image, half, x, len([i FOR i IN range(0, least(length(x), length(y)) // 2) IF substr(x, CAST(2 * i + 1 AS INTEGER), 2) <> substr(y, CAST(2 * i + 1 AS INTEGER), 2)]) + abs(length(x) - length(y)) // 2 AS differing FROM p)"""


@query("prot13_fat_track", f"WITH {_FAT} SELECT image, half AS track, half + 1 AS half_track, CAST(differing AS BIGINT) AS differing, differing < 2 AS copied, CASE WHEN differing < 2 THEN md5(x) END AS digest FROM d")
def fat_track(spark, sf):
    """Tracks two half tracks apart that differ in fewer than two bytes: the first's bytes are taken for the half track between them as well."""
    n = F.least(F.col("image") % 4, F.floor(F.length("before") / 2))
    l = images(spark, sf).withColumn("before", F.lag("data").over(Window.partitionBy("image").orderBy("chunk")))
    changed = F.concat(F.substring(F.lit("000000"), F.lit(1), (n * 2).cast("int")), F.substring("before", (n * 2 + 1).cast("int"), F.length("before")))
    t = l.select("image", (F.col("chunk") * 2).alias("track"), F.when((F.col("image") % 3 == 0) & (F.col("chunk") % 2 == 1), changed).otherwise(F.col("data")).alias("x"))
    both = t.join(t.select("image", (F.col("track") - 2).alias("track"), F.col("x").alias("y")), ["image", "track"])
    pairs = compare.equal_bytes(both.select("image", "track", F.unhex("x").alias("x"), F.unhex("y").alias("y")), "x", "y")
    differing = F.greatest(F.octet_length("x"), F.octet_length("y")) - F.col("same")
    d = pairs.withColumn("differing", differing)
    return d.select("image", "track", (F.col("track") + 1).alias("half_track"), "differing", (F.col("differing") < 2).alias("copied"), F.when(F.col("differing") < 2, F.md5(F.hex("x"))).alias("digest"))


@query("prot14_apple_rules", f"""WITH {NOISE}, t AS (SELECT image, chunk, CASE image % 4 WHEN 0 THEN 'D5AA96' WHEN 1 THEN 'D5AAB5' WHEN 2 THEN 'D4AA96' ELSE 'D5AA97' END || data AS data FROM noise), r AS (SELECT image, chunk, regexp_matches(data, '^(?:..)*?D5AA96') AS std, regexp_matches(data, '^(?:..)*?D5AAB5') AS old13, regexp_matches(data, '^(?:..)*?D4AA') AS other, {_count_sql('D5')} AS syncs FROM t)
  SELECT image, count(*) FILTER (NOT std AND other) AS changed_address, count(*) FILTER (old13) AS old_format, count(*) FILTER (syncs > 3) AS many_marks, CASE WHEN count(*) FILTER (NOT std AND other) > 0 THEN 'NIBBLE' WHEN count(*) FILTER (old13) > 0 THEN 'FORMAT' ELSE 'NONE' END AS scheme FROM r GROUP BY image""")
def apple_rules(spark, sf):
    """Changed address marks, the older format and surplus marks over all tracks of a disk."""
    i = F.col("image")
    t = noise(spark, sf).select("image", "chunk", F.concat(F.when(i % 4 == 0, "D5AA96").when(i % 4 == 1, "D5AAB5").when(i % 4 == 2, "D4AA96").otherwise("D5AA97"), "data").alias("data"))
    has = lambda p: F.col("data").rlike(f"^(?:..)*?{p}")
    r = t.select("image", has("D5AA96").alias("std"), has("D5AAB5").alias("old13"), has("D4AA").alias("other"), _count(F.col("data"), "D5").alias("syncs"))
    changed, old = F.count_if(~F.col("std") & F.col("other")), F.count_if("old13")
    return r.groupBy("image").agg(changed.alias("changed_address"), old.alias("old_format"), F.count_if(F.col("syncs") > 3).alias("many_marks"), F.when(changed > 0, "NIBBLE").when(old > 0, "FORMAT").otherwise("NONE").alias("scheme"))


@query("prot16_atari_rules", f"""WITH {SECTORS}, t AS (SELECT track, count(DISTINCT sector) AS n, max(sector) AS top, count(*) FILTER (NOT crc_ok) AS bad, count(DISTINCT sector) FILTER (deleted) AS marks, count(*) FILTER (weak) AS fuzzy FROM sectors GROUP BY track)
  SELECT track, CAST((top > 6)::INT + 2 * (n < top)::INT + 4 * (bad > 2)::INT + 8 * (fuzzy >= 3)::INT AS BIGINT) AS mask, CASE WHEN fuzzy >= 3 AND bad > 2 THEN 'FUZZY' WHEN n < top THEN 'MISSING' WHEN top > 6 THEN 'EXTRA' ELSE 'NONE' END AS scheme FROM t""")
def atari_rules(spark, sf):
    """Extra, missing, bad and fuzzy sectors as a mask, and the scheme that they make likely."""
    t = sectors(spark, sf).groupBy("track").agg(F.count_distinct("sector").alias("n"), F.max("sector").alias("top"), F.count_if(~F.col("crc_ok")).alias("bad"), F.count_if("weak").alias("fuzzy"))
    extra, gone, bad, fuzzy = F.col("top") > 6, F.col("n") < F.col("top"), F.col("bad") > 2, F.col("fuzzy") >= 3
    mask = sum((c.cast("long") * (1 << k) for k, c in enumerate((extra, gone, bad, fuzzy))), F.lit(0).cast("long"))
    return t.select("track", mask.alias("mask"), F.when(fuzzy & bad, "FUZZY").when(gone, "MISSING").when(extra, "EXTRA").otherwise("NONE").alias("scheme"))


#: Signatures of the page scan: the benchmark's words of five letters or more, the first in either case.
WORDS = "words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS name FROM benchmark)"


@query("prot17_byte_signatures", f"""WITH {WORDS}, s AS (SELECT name, upper(name[1:1]) || name[2:] AS a, lower(name[1:1]) || name[2:] AS b FROM words), p AS (SELECT page_id AS image, html AS h FROM pages WHERE length(html) > 0),
  x AS (SELECT image, name, h, least(coalesce(nullif(instr(h, a), 0), 1e9::BIGINT), coalesce(nullif(instr(h, b), 0), 1e9::BIGINT)) AS place FROM p, s WHERE contains(h, a) OR contains(h, b))
  SELECT image, name, CAST(strlen(substr(h, 1, CAST(place - 1 AS INTEGER))) AS BIGINT) AS first_byte, CAST(50 + 2 * least(20, length(name)) AS INTEGER) AS conf FROM x""")
def byte_signatures(spark, sf):
    """Byte signatures in whole buffers, the first place of each; a longer one is surer."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("sig")).distinct()
    signs = words.select("sig", F.col("sig").cast("binary").alias("pattern"), F.unhex(F.concat(F.lit("DF"), F.repeat(F.lit("FF"), F.length("sig") - 1))).alias("mask"))
    found = sg.scan(table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("content")), signs)
    return found.select(F.col("key").alias("image"), F.col("sig").alias("name"), F.col("offset_at").alias("first_byte"), (F.least(F.length("sig"), F.lit(20)) * 2 + 50).alias("conf"))


# Fixed values of this example: signatures of the boot block; the first must begin it.
_BOOT = ["GEOS", "The ", "and "]


@query("prot18_boot_signature", f"WITH t AS (SELECT doc_id AS image, hex(encode(text)) AS h FROM documents WHERE length(text) > 0) SELECT image, starts_with(h, '{_BOOT[0].encode().hex().upper()}') OR regexp_matches(substr(h, 1, 512), '^(?:..)*?(?:{'|'.join(b.encode().hex().upper() for b in _BOOT[1:])})') AS signed, CAST(length(h) // 2 AS BIGINT) AS size, CASE WHEN length(h) // 2 >= 512 THEN 'FULL' ELSE 'SHORT' END AS boot FROM t")
def boot_signature(spark, sf):
    """A signature within the boot block, and whether the block is whole."""
    t = table(spark, sf, "documents").where("octet_length(text) > 0").select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("content"))
    signs = spark.createDataFrame([(b, bytearray(b.encode()), None) for b in _BOOT], "sig string, pattern binary, mask binary")
    found = sg.scan(t.select("key", F.substring("content", 1, 256).alias("content")), signs).where(f"sig <> '{_BOOT[0]}' OR offset_at = 0").select("key").distinct()
    size = F.octet_length("content").cast("long")
    both = t.select("key", size.alias("size")).join(found.withColumn("signed", F.lit(True)), "key", "left")
    return both.select(F.col("key").alias("image"), F.coalesce("signed", F.lit(False)).alias("signed"), "size", F.when(F.col("size") >= 512, "FULL").otherwise("SHORT").alias("boot"))


@query("prot19_probe_flux", f"""WITH {PULSES}, r AS (SELECT track // 5 AS disk, track % 5 AS rev, count(*) AS n, CAST(sum(dt) AS BIGINT) AS ns FROM pulses GROUP BY 1, 2), d AS (SELECT disk, rev, n, ns, max(n) OVER (PARTITION BY disk) - min(n) OVER (PARTITION BY disk) AS spread FROM r)
  SELECT disk, count(*) AS revolutions, CAST(sum(n) AS BIGINT) AS transitions, max(spread) AS spread, max(spread) > 10 AS weak FROM d GROUP BY disk""")
def probe_flux(spark, sf):
    """Revolutions, transitions, and whether the revolutions' numbers of transitions differ by more than the tolerance."""
    r = pulses(spark, sf).groupBy(F.expr("track div 5").alias("disk"), (F.col("track") % 5).alias("rev")).agg(F.count("*").alias("n"))
    spread = F.max("n") - F.min("n")
    return r.groupBy("disk").agg(F.count("*").alias("revolutions"), F.sum("n").alias("transitions"), spread.alias("spread"), (spread > 10).alias("weak"))


@query("prot20_multi_read", f"""WITH {SECTORS}, r AS (SELECT track, sector, count(DISTINCT data) AS v, count(DISTINCT crc_ok) AS states FROM sectors GROUP BY 1, 2), t AS (SELECT track, count(*) FILTER (v > 1) AS weak, count(*) FILTER (states > 1) AS unsure, count(*) AS n FROM r GROUP BY track)
  SELECT track, weak AS weak_sectors, CASE WHEN weak = 0 THEN 'NONE' WHEN weak = n THEN 'FLAKEY_DISK' WHEN unsure > 0 THEN 'WEAK_SECTOR' ELSE 'WEAK_BITS' END AS scheme, CASE WHEN weak > 0 THEN 80 ELSE 0 END AS confidence FROM t""")
def multi_read(spark, sf):
    """Where reads disagree decides the scheme; its confidence is fixed."""
    r = sectors(spark, sf).groupBy("track", "sector").agg(F.count_distinct("data").alias("v"), F.count_distinct("crc_ok").alias("states"))
    t = r.groupBy("track").agg(F.count_if(F.col("v") > 1).alias("weak_sectors"), F.count_if(F.col("states") > 1).alias("unsure"), F.count("*").alias("n"))
    w = F.col("weak_sectors")
    return t.select("track", "weak_sectors", F.when(w == 0, "NONE").when(w == F.col("n"), "FLAKEY_DISK").when(F.col("unsure") > 0, "WEAK_SECTOR").otherwise("WEAK_BITS").alias("scheme"), F.when(w > 0, 80).otherwise(0).alias("confidence"))
