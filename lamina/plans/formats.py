"""Format detection over the bytes of files: probes, scores, boot records, geometry, suggestions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import octets
from ..operators import probing as pr
from ..sources import disks, samples
from ..sources.carriers import FLUX, flux, table
from ..sources.storage import stored
from .base import query

def _list(values) -> str:
    return "(" + ", ".join(map(str, values)) + ")"


#: Bytes of a file's beginning that the SQL spells out; what lies beyond is filler or one known structure.
_SPELT = 7680
_KIND_ROWS = ", ".join(
    f"({i}, {size}, '{ext}', " + ", ".join(f"{at}, '{data[:_SPELT].hex()}'" for at, data in [*parts, *[(None, b"")] * (2 - len(parts))]).replace("None, ''", "NULL, NULL") + ")" for i, (_, size, ext, parts) in enumerate(samples.KINDS))
_LAY = "CASE WHEN {o} IS NULL OR {o} >= %d THEN {h} ELSE substr(substr({h}, 1, CAST(2 * {o} AS INTEGER)) || {x} || substr({h}, CAST(2 * {o} + length({x}) + 1 AS INTEGER)), 1, %d) END" % (_SPELT, 2 * _SPELT)
#: id, kind, damage, ext, n (length), m (digits of the filler), h (digits of the first bytes), o1, x1, o2, x2 (structures and where they stand).
FILES = f"""kinds AS (SELECT * FROM (VALUES {_KIND_ROWS}) AS t(kind, size, ext, o1, x1, o2, x2)),
  pick AS (SELECT s_suppkey AS id, CAST(s_suppkey % {len(samples.KINDS)} AS INTEGER) AS kind, CAST((s_suppkey // {len(samples.KINDS)} + s_nationkey) % {len(samples.DAMAGES)} AS INTEGER) AS damage FROM supplier),
  laid AS (SELECT id, kind, damage, ext, CASE damage WHEN 2 THEN size // 2 WHEN 4 THEN size + 1 ELSE size END AS n, lower(hex(md5(CAST(id AS VARCHAR)))) AS m,
    CASE WHEN damage = 3 AND o2 IS NULL THEN NULL ELSE o1 END AS o1, x1, CASE WHEN damage = 3 THEN NULL ELSE o2 END AS o2, x2 FROM pick JOIN kinds USING (kind)),
  once AS (SELECT *, {_LAY.format(o="o1", x="x1", h=f"repeat(m, {_SPELT // 32})")} AS h1 FROM laid), twice AS (SELECT *, substr({_LAY.format(o="o2", x="x2", h="h1")}, 1, CAST(2 * n AS INTEGER)) AS h2 FROM once),
  files AS (SELECT id, kind, damage, ext, n, m, o1, x1, o2, x2, CASE WHEN damage = 1 AND n > 0 THEN lower(printf('%02x', xor(CAST('0x' || substr(h2, 1, 2) AS INTEGER), 32))) || substr(h2, 3) ELSE h2 END AS h FROM twice)"""


def _byte(at: int) -> str:
    return f"TRY_CAST('0x' || substr(h, {2 * at + 1}, 2) AS BIGINT)"


def _le(at: int, n: int = 2) -> str:
    return "(" + " + ".join(f"{_byte(at + i)} * {256**i}" for i in range(n)) + ")"


def _be(at: int, n: int = 2) -> str:
    return "(" + " + ".join(f"{_byte(at + n - 1 - i)} * {256**i}" for i in range(n)) + ")"


def _far(at: int) -> str:
    return f"CASE WHEN o1 = {at} THEN substr(x1, 1, 6) ELSE substr(m, 1, 6) END"


def _starts(*words: bytes) -> str:
    return "(" + " OR ".join(f"starts_with(h, '{w.hex()}')" for w in words) + ")"


def _rules(whole: bool) -> dict[str, str]:
    """Each format's confidence in a file of n bytes that begin with h; whole: the probe sees all of it."""
    far = lambda at, link, mark, base, linked, marked: f"CASE WHEN substr({_far(at)}, 1, 4) = '{link}' THEN {linked} WHEN substr({_far(at)}, 5, 2) = '{mark}' THEN {marked} ELSE {base} END" if whole else str(base)
    of = lambda name: _list(pr.LENGTHS[name])
    sized = lambda name, value: f"CASE WHEN n IN {of(name)} THEN {value} ELSE 0 END"
    marked = lambda word, least, value: f"CASE WHEN n >= {least} AND {_starts(*word) if isinstance(word, tuple) else _starts(word)} THEN {value} ELSE 0 END"
    shape = " OR ".join(f"(n // 512 % {h * t} = 0 AND n // 512 // {h * t} BETWEEN 35 AND 84)" for h in pr.HEADS for t in pr.TRACKS)
    oem = " AND ".join(f"{_byte(i)} BETWEEN 32 AND 126" for i in range(3, 11))
    starts = f"list_filter(list_transform(range(164), lambda i: TRY_CAST('0x' || substr(h, CAST(71 + 8 * i AS INTEGER), 2) || substr(h, CAST(69 + 8 * i AS INTEGER), 2) || substr(h, CAST(67 + 8 * i AS INTEGER), 2) || substr(h, CAST(65 + 8 * i AS INTEGER), 2) AS BIGINT)), lambda x: x > 0)"
    name = " AND ".join(f"({_byte(i)} = 0 OR ({_byte(i)} >= 32 AND {_byte(i)} <> 127))" for i in range(17))
    ones = "len(list_filter(range(6656), lambda i: substr(h, CAST(2 * i + 1 AS INTEGER), 2) = 'ff'))"
    total = "list_sum(list_transform(range(133), lambda i: TRY_CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)))"
    return {
        "D64": sized("D64", far(0x16500, "1201", "41", 75, 92, 88)), "D71": sized("D71", far(0x16500, "1201", "--", 70, 90, 90)), "D81": sized("D81", far(0x61800, "2803", "44", 80, 92, 88)),
        "ADF": sized("ADF", f"CASE WHEN {_starts(b'DOS')} THEN 95 ELSE 70 END"),
        "IMG": f"CASE WHEN n IN {of('IMG')} OR (n > 0 AND n % 512 = 0 AND ({shape})) THEN CASE WHEN n < 512 THEN 40 WHEN {_le(11)} = 512 THEN 90 WHEN {oem} THEN 85 WHEN {_byte(510)} = 85 AND {_byte(511)} = 170 THEN 80 WHEN {_byte(0)} IN (233, 235) THEN 60 ELSE 40 END ELSE 0 END",
        "XFD": f"CASE WHEN n IN {of('XFD')} THEN CASE WHEN {_byte(0)} IN (0, 1) AND {_byte(3)} BETWEEN 7 AND 191 THEN 82 ELSE 40 END WHEN n > 0 AND n <= 266240 AND n % 128 = 0 THEN 25 ELSE 0 END",
        "JV1": "CASE WHEN n > 0 AND n % 2560 = 0 AND (n // 2560 <= 40 OR (n // 2560 <= 80 AND n // 2560 % 2 = 0)) THEN 35 ELSE 0 END", "DO": sized("DO", "60"), "PO": sized("PO", "55"),
        "NIB": sized("NIB", f"CASE WHEN len(regexp_extract_all(substr(h, 1, 13312), 'd5aa96')) >= 10 AND {ones} > 500 THEN 95 WHEN {ones} > 200 THEN 88 ELSE 80 END"),
        "TRD": sized("TRD", f"CASE WHEN {_byte(0x227)} = 16 THEN 92 WHEN {_byte(0x8E4)} <= 128 THEN 82 ELSE 70 END"),
        "SCP": marked(b"SCP", 16, f"CASE WHEN {_byte(3)} <= 47 THEN 95 ELSE 50 END"),
        "HFE": marked((b"HXCPICFE", b"HXCHFEV3"), 512, f"95 + CASE WHEN {_byte(9)} BETWEEN 1 AND 84 THEN 2 ELSE 0 END + CASE WHEN {_byte(10)} BETWEEN 1 AND 2 THEN 2 ELSE 0 END + CASE WHEN {_le(12)} BETWEEN 125 AND 1000 THEN 1 ELSE 0 END"),
        "G64": marked(b"GCR-1541", 12, f"CASE WHEN n >= 12 + 8 * {_byte(9)} THEN 100 WHEN {_le(10)} BETWEEN 1 AND 7928 THEN 98 WHEN {_byte(9)} BETWEEN 1 AND 84 THEN 95 WHEN {_byte(8)} = 0 THEN 90 ELSE 80 END"),
        "IMD": marked(b"IMD ", 4, "95"), "ATR": marked(b"\x96\x02", 16, "95"), "TD0": marked((b"TD", b"td"), 2, "95"), "STX": marked(b"RSY\x00", 16, "97"), "IPF": marked(b"CAPS", 12, "95"), "ATX": marked(b"AT8X", 48, "98"), "2IMG": marked(b"2IMG", 64, "95"),
        "CPC": marked((b"MV - CPC", b"EXTENDED"), 8, "95"), "SCL": marked(b"SINCLAIR", 9, "96"), "FDI": marked(b"FDI", 14, f"CASE WHEN {_le(4)} BETWEEN 1 AND 180 AND {_le(6)} BETWEEN 1 AND 2 THEN 92 ELSE 75 END"),
        "DC42": f"CASE WHEN n >= 84 AND {_be(82)} = 256 AND {_byte(0)} <= 63 AND {_be(64, 4)} > 0 THEN CASE WHEN {_byte(80)} > 3 THEN 50 ELSE 92 END ELSE 0 END",
        "CQM": marked(b"CQ\x14", 3, f"CASE WHEN n >= 133 AND {total} % 256 = 0 AND {_le(18)} BETWEEN 1 AND 2 AND {_le(16)} BETWEEN 1 AND 64 AND {_byte(90)} >= 1 AND {_le(3)} IN (128, 256, 512, 1024, 2048, 4096, 8192) THEN 95 ELSE 60 END"),
        "MSA": marked(b"\x0e\x0f", 10, f"CASE WHEN {_be(2)} BETWEEN 1 AND 18 AND {_be(4)} <= 1 AND {_be(8)} >= {_be(6)} THEN 70 + CASE WHEN {_byte(2)} + {_byte(4)} + {_byte(6)} + {_byte(8)} = 0 THEN 20 ELSE 0 END + CASE WHEN {_be(8)} < 90 THEN 5 ELSE 0 END ELSE 0 END"),
        "D88": f"CASE WHEN n >= 688 AND {_le(28, 4)} BETWEEN 688 AND n AND {_byte(27)} IN (0, 16, 32, 48, 64) AND len({starts}) > 0 AND list_sort(list_distinct({starts})) = {starts} AND list_min({starts}) >= 688 AND list_max({starts}) < {_le(28, 4)}"
               f" THEN 60 + CASE WHEN {_le(28, 4)} = n THEN 20 ELSE 0 END + CASE WHEN {_byte(26)} IN (0, 16) THEN 10 ELSE 0 END + CASE WHEN {name} THEN 5 ELSE 0 END ELSE 0 END",
    }


def _claims_sql(name: str, whole: bool, source: str = "files") -> str:
    """A table of the claims that the rules give."""
    rules = _rules(whole)
    rows = ", ".join(f"{{'format': '{f}', 'reg': {pr.REG[f]}, 'conf': {rules[f]}}}" for f, _ in pr.FORMATS)
    return f"{name}_all AS (SELECT id, unnest([{rows}]) AS x FROM {source}), {name} AS (SELECT id, x.format AS format, x.reg AS reg, x.conf AS conf FROM {name}_all WHERE x.conf > 0)"


#: What the files' beginnings claim, and what the whole files do.
CLAIMS = f"{FILES}, {_claims_sql('claims', False)}"
WHOLE = f"{FILES}, {_claims_sql('claims', True)}"


def _picked(spark, sf):
    """id, kind, damage, ext of each supplier's file; every third extension is written in capitals."""
    k = F.col("s_suppkey")
    kind = (k % len(samples.KINDS)).cast("int")
    damage = ((F.floor(k / len(samples.KINDS)) + F.col("s_nationkey")) % len(samples.DAMAGES)).cast("int")
    return table(spark, sf, "supplier").select(k.alias("id"), kind.alias("kind"), damage.alias("damage"), F.get(F.array(*[F.lit(x[2]) for x in samples.KINDS]), kind).alias("ext"))


def _files(spark, sf):
    """path, length, content: the written files, kept in the shared folder."""
    return stored(samples.written(_picked(spark, sf)), "files")


def _id(df):
    return df.withColumn("id", F.substring_index("path", ".", 1).cast("long")).drop("path")


@query("src02_ranked_file", f"""WITH {CLAIMS}, r AS (SELECT *, max(conf) OVER (PARTITION BY id) AS top FROM claims)
  SELECT id, arg_min(format, reg) FILTER (conf = top) AS winner, CAST(max(conf) AS INTEGER) AS conf, count(*) AS claimants, count(*) FILTER (conf = top) AS tied, arg_max(format, conf * 100 - reg) FILTER (conf < top) AS runner_up FROM r GROUP BY id""")
def ranked_file(spark, sf):
    """The first 64 KB of each file: winner, how many formats claim it, how many as well as the winner, the best below."""
    return _id(pr.ranking(pr.claims(_files(spark, sf))))


@query("src05_detect_buffer", f"WITH {WHOLE} SELECT files.id, c.format, CASE WHEN c.format IS NOT NULL THEN 90 ELSE 0 END AS confidence FROM files LEFT JOIN (SELECT id, arg_max(format, conf * 100 - reg) AS format FROM claims GROUP BY id) c ON c.id = files.id")
def detect_buffer(spark, sf):
    """The winner of the probe of the whole content with a fixed confidence; names are not looked at."""
    files = _files(spark, sf)
    won = pr.claims(files, window=None).groupBy("path").agg(F.max_by("format", F.struct("conf", -F.col("reg"))).alias("format"))
    return _id(files.select("path").join(won, "path", "left").select("path", "format", F.when(F.col("format").isNotNull(), 90).otherwise(0).alias("confidence")))


HEADER = 1024


@query("src06_detect_header", f"WITH {FILES}, cut AS (SELECT id, m, o1, x1, substr(h, 1, {2 * HEADER}) AS h, least(n, {HEADER}) AS n FROM files), {_claims_sql('claims', False, 'cut')} SELECT id, arg_max(format, conf * 100 - reg) AS format, 90 AS score FROM claims GROUP BY id")
def detect_header(spark, sf):
    """A header alone is the whole buffer: its own length is the file's."""
    head = _files(spark, sf).select("path", F.least(F.col("length"), F.lit(HEADER)).alias("length"), F.substring("content", 1, HEADER).alias("content"))
    return _id(pr.claims(head).groupBy("path").agg(F.max_by("format", F.struct("conf", -F.col("reg"))).alias("format")).withColumn("score", F.lit(90)))


def _sizes(s) -> str:
    return f"n IN {_list(s.sizes)}" if s.sizes else "false"


def _first_sql() -> str:
    mark = f"(n >= 512 AND {_byte(510)} = 85 AND {_byte(511)} = 170 AND {_le(11)} = 512)"
    system = {"FAT": (mark, 0.8), "OFS": (f"(n >= 512 AND {_starts(b'DOS')})", 0.85), "CBM": (f"(n > {0x16502} AND substr({_far(0x16500)}, 1, 2) = '12')", 0.85)}
    rows = []
    for i, s in enumerate(pr.FIRST):
        v = f"{s.prior}::DOUBLE"
        if s.sizes:
            v += f" * CASE WHEN {_sizes(s)} THEN 0.9::DOUBLE ELSE 0.1 END"
        if s.magic:
            v += f" * CASE WHEN n < {max(4, len(s.magic))} THEN 1::DOUBLE WHEN {_starts(s.magic)} THEN 0.95 ELSE 0.01 END"
        if s.filesystem:
            v += f" * CASE WHEN {system[s.filesystem][0]} THEN {system[s.filesystem][1]}::DOUBLE ELSE 1 END"
        rows.append(f"{{'format': '{s.name}', 'reg': {i}, 'v': {v}}}")
    return ", ".join(rows)


BAYES = """p AS (SELECT id, x.format AS format, x.reg AS reg, round(x.v / sum(x.v) OVER (PARTITION BY id), 9) AS post FROM l), r AS (SELECT *, row_number() OVER w AS k, lead(format) OVER w AS second, lead(post) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY id ORDER BY post DESC, reg))"""


@query("src07_bayesian_detect", f"WITH {FILES}, l AS (SELECT id, unnest([{_first_sql()}]) AS x FROM files WHERE n > 0), {BAYES} SELECT id, format AS best, round(post * 100, 4) AS confidence, second, nxt > post * 0.7 AS ambiguous FROM r WHERE k = 1")
def bayesian_first(spark, sf):
    """Prior, length, signature and file system of thirteen formats; a file without bytes has no answer."""
    got = pr.posteriors(_files(spark, sf).where("length > 0"), pr.FIRST, pr.evidence_first)
    return _id(got.select("path", "best", F.round(F.col("post") * 100, 4).alias("confidence"), "second", (F.col("next") > F.col("post") * 0.7).alias("ambiguous")))


def _second_sql(whole: bool) -> str:
    """The three scores of each format; whole: structure is judged by all bytes, else by the first 64."""
    long = lambda n: f"n >= {n}" if whole else "false"
    far = _far(91392)
    digit = lambda at: f"CAST('0x' || substr({far}, {at}, 2) AS BIGINT)"
    checks = {
        "D64": f"({long(174848)} AND {digit(1)} <= 40 AND {digit(3)} <= 21 AND {digit(5)} IN (65, 0))", "ADF": f"({long(901120)})",
        "SCP": f"(n >= 16 AND {_starts(b'SCP')} AND {_byte(3)} <= 41 AND {_byte(6)} <= {_byte(7)} AND {_byte(5)} BETWEEN 1 AND 32)", "G64": f"(n >= 12 AND {_starts(b'GCR-1541')} AND {_byte(8)} = 0 AND {_byte(9)} BETWEEN 1 AND 168)"}
    rows = []
    for i, s in enumerate(pr.SECOND):
        near = " OR ".join(f"(n::DOUBLE / {x} > 0.9 AND n::DOUBLE / {x} < 1.1)" for x in s.sizes) or "false"
        size = f"CASE WHEN {_sizes(s)} THEN 1.0::DOUBLE WHEN n BETWEEN {s.least} AND {s.most} THEN 0.5 WHEN {near} THEN 0.3 ELSE 0.01 END"
        agree = " + ".join(f"CASE WHEN {_byte(k)} = {c} THEN 1 ELSE 0 END" for k, c in enumerate(s.magic)) or "0"
        magic = f"CASE WHEN n < {len(s.magic)} THEN 0.01::DOUBLE WHEN {agree} = {len(s.magic)} THEN 1.0 ELSE ({agree})::DOUBLE / {len(s.magic)} * 0.5 END" if s.magic else "0.5::DOUBLE"
        structure = f"CASE WHEN {checks[s.name]} THEN 1.0::DOUBLE ELSE 0.1 END" if s.check else "0.5::DOUBLE"
        rows.append(f"{{'format': '{s.name}', 'reg': {i}, 'prior': {s.prior}::DOUBLE, 'a': {size}, 'b': {magic}, 'c': {structure}}}")
    return ", ".join(rows)


@query("src08_bayesian_detect", f"""WITH {FILES}, e AS (SELECT id, unnest([{_second_sql(False)}]) AS x FROM files), l AS (SELECT id, {{'format': x.format, 'reg': x.reg, 'v': x.prior * pow(x.a * x.b * x.c, 1.0::DOUBLE / 3)}} AS x FROM e), {BAYES}
  SELECT id, format AS best, round(post * 100, 4) AS confidence, post * 100 < 70 AS low, round((post - nxt) * 100, 6) < 20 AS ambiguous FROM r WHERE k = 1""")
def bayesian_second(spark, sf):
    """Prior times the cubic mean of length, signature and structure of seven formats, all judged by the first 64 bytes."""
    got = pr.posteriors(_files(spark, sf), pr.SECOND, pr.evidence_second, window=64)
    post = F.col("post") * 100
    return _id(got.select("path", "best", F.round(post, 4).alias("confidence"), (post < 70).alias("low"), (F.round((F.col("post") - F.col("next")) * 100, 6) < 20).alias("ambiguous")))


@query("src11_structure_score", f"WITH {FILES}, e AS (SELECT id, unnest([{_second_sql(True)}]) AS x FROM files) SELECT id, x.format AS format, round(x.a, 6) AS size_score, round(x.b, 6) AS magic_score, x.c AS structure_score FROM e")
def structure_score(spark, sf):
    """Seven formats' scores in each whole file."""
    return _id(pr.score_table(_files(spark, sf)).select("path", "format", F.round("size_score", 6).alias("size_score"), F.round("magic_score", 6).alias("magic_score"), "structure_score"))


@query("src12_common_formats", f"""WITH {FILES}, c AS (SELECT id, [x FOR x IN [CASE WHEN n >= 8 AND {_starts(b'SCP')} THEN 'SCP:0.95' END, CASE WHEN n >= 8 AND {_starts(b'GCR-1541')} THEN 'G64:0.95' END, CASE WHEN n >= 8 AND {_starts(b'HXCPICFE')} THEN 'HFE:0.95' END, CASE WHEN n >= 8 AND {_starts(b'IMD ')} THEN 'IMD:0.95' END,
  CASE WHEN n IN (174848, 175531, 196608, 197376) THEN 'D64:0.85' END, CASE WHEN n IN (901120, 1802240) THEN 'ADF:0.85' END] IF x IS NOT NULL] AS f FROM files) SELECT id, array_to_string(f, ',') AS found, CAST(len(f) AS BIGINT) AS n FROM c""")
def common_formats(spark, sf):
    """Four formats by their signatures, two by their lengths; each with its fixed probability."""
    head = lambda word, name: F.when((F.col("length") >= 8) & F.col("head").startswith(F.lit(word)), F.lit(f"{name}:0.95"))
    found = F.array_compact(F.array(head(b"SCP", "SCP"), head(b"GCR-1541", "G64"), head(b"HXCPICFE", "HFE"), head(b"IMD ", "IMD"), F.when(F.col("length").isin(174848, 175531, 196608, 197376), F.lit("D64:0.85")),
                                    F.when(F.col("length").isin(901120, 1802240), F.lit("ADF:0.85"))))
    return _id(_files(spark, sf).withColumn("head", F.substring("content", 1, 8)).select("path", F.array_join(found, ",").alias("found"), F.size(found).cast("long").alias("n")))


#: Sectors and good ones of the kinds whose bytes are sectors: by length, by the error map, by the dump's records.
_OPENED = f"""opened AS (SELECT w.id, w.format, CASE WHEN w.format = 'D64' THEN CASE WHEN n IN (174848, 175531) THEN 683 WHEN n IN (196608, 197376) THEN 768 WHEN n IN (200960, 201745) THEN 785 ELSE 802 END WHEN w.format = 'ADF' THEN n // 512 WHEN w.format = 'IMG' THEN n // 512 WHEN w.format = 'D71' THEN 1366 WHEN w.format = 'D81' THEN 3200
    WHEN w.format = 'ATR' THEN (n - 16) // 128 WHEN w.format = 'DO' THEN 560 WHEN w.format = 'IMD' THEN CASE WHEN damage = 2 THEN {{dumped}} ELSE 54 END ELSE 0 END AS sectors,
  CASE WHEN w.format = 'D64' AND n = 175531 THEN CASE WHEN o2 IS NULL THEN 0 ELSE {sum(e == 1 for e in samples._ERRORS)} END WHEN w.format = 'IMD' THEN CASE WHEN damage = 2 THEN {{dumped_good}} ELSE {{whole_good}} END END AS fewer FROM w JOIN files ON files.id = w.id)"""


def _dumped(raw: bytes) -> tuple[int, int]:
    got = disks.read_dump(raw)
    return len(got), sum(r[5] == "OK" for r in got)


_HALF, _FULL = _dumped(samples._DUMP[: len(samples._DUMP) // 2]), _dumped(samples._DUMP)


@query("src13_smart_open", f"""WITH {CLAIMS}, t AS (SELECT *, max(conf) OVER (PARTITION BY id) AS top FROM claims), w AS (SELECT id, arg_min(format, reg) FILTER (conf = top) AS format, count(*) FILTER (conf = top) > 1 AS warned FROM t GROUP BY id),
  {_OPENED.format(dumped=_HALF[0], dumped_good=_HALF[1], whole_good=_FULL[1])}, q AS (SELECT id, CAST(sectors AS BIGINT) AS sectors, CAST(coalesce(fewer, sectors) AS BIGINT) AS good FROM opened)
  SELECT id, format, warned, sectors, good, CASE WHEN sectors = 0 THEN 'UNKNOWN' WHEN good * 100 // sectors = 100 THEN 'PERFECT' WHEN good * 100 // sectors >= 95 THEN 'GOOD' WHEN good * 100 // sectors >= 80 THEN 'FAIR' WHEN good * 100 // sectors >= 50 THEN 'POOR' WHEN good > 0 THEN 'BAD' ELSE 'UNREADABLE' END AS level FROM w JOIN q USING (id)""")
def smart_open(spark, sf):
    """The probe's winner (a tie is only a warning), the sectors that its reader finds, and a quality level from the good ones."""
    few = _picked(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism, "id")  # short rows become long files
    j = pr.opened(samples.written(few), disks.READERS)
    pct = F.expr("try_divide(good * 100, sectors)").cast("int")
    level = F.when(F.col("sectors") == 0, "UNKNOWN").when(pct == 100, "PERFECT").when(pct >= 95, "GOOD").when(pct >= 80, "FAIR").when(pct >= 50, "POOR").when(F.col("good") > 0, "BAD").otherwise("UNREADABLE")
    return _id(j.select("path", "format", "warned", "sectors", "good", level.alias("level")))


_SPECS = "specs AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {pr.REG[f]}, {e}, {pr.LENGTHS.get(f, [])}::BIGINT[])" for f, e in pr.FORMATS) + ") AS t(format, reg, exts, sizes))"


def _specs(spark):
    return spark.createDataFrame([(f, pr.REG[f], e, pr.LENGTHS.get(f, [])) for f, e in pr.FORMATS], "format string, reg int, exts array<string>, sizes array<long>")  # a row a format


@query("src14_extension_lookup", f"WITH {FILES}, {_SPECS}, e AS (SELECT x AS ext, arg_min(format, reg) AS format FROM specs, unnest(exts) AS u(x) GROUP BY x) SELECT id, e.format FROM files LEFT JOIN e ON e.ext = lower(files.ext)")
def extension_lookup(spark, sf):
    """The format registered first among those that claim the extension, whatever its case."""
    by = _specs(spark).select("format", "reg", F.explode("exts").alias("low")).groupBy("low").agg(F.min_by("format", "reg").alias("format"))
    named = _files(spark, sf).select("path", F.lower(F.substring_index("path", ".", -1)).alias("low"))
    return _id(named.join(F.broadcast(by), "low", "left").select("path", "format"))


@query("src16_lookup_by_name", f"WITH {FILES}, {_SPECS} SELECT id, format, reg, CAST(len(sizes) AS INTEGER) AS lengths FROM files JOIN specs ON format = upper(ext)")
def lookup_by_name(spark, sf):
    """Formats whose name is the file's extension."""
    named = _files(spark, sf).select("path", F.upper(F.substring_index("path", ".", -1)).alias("format"))
    return _id(named.join(F.broadcast(_specs(spark)), "format").select("path", "format", "reg", F.size("sizes").alias("lengths")))


REGISTER = "tries AS (SELECT s_suppkey AS step, 'plugin' || s_nationkey AS name, s_suppkey % 5 > 0 AS abi FROM supplier), ranked AS (SELECT *, row_number() OVER (PARTITION BY name, abi ORDER BY step) AS k FROM tries)"


@query("src17_register", f"WITH {REGISTER}, a AS (SELECT step, row_number() OVER (ORDER BY step) AS place FROM ranked WHERE abi AND k = 1) SELECT r.step, name, CASE WHEN NOT abi THEN 'ABI' WHEN k > 1 THEN 'DUPLICATE' WHEN place > 192 THEN 'FULL' ELSE 'OK' END AS status FROM ranked r LEFT JOIN a ON a.step = r.step")
def register(spark, sf):
    """Plugins asking to be registered one after another: wrong interface, name taken, table of 192 full."""
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("step"), F.concat(F.lit("plugin"), F.col("s_nationkey").cast("string")).alias("name"), (F.col("s_suppkey") % 5 > 0).alias("abi"))
    r = t.withColumn("k", F.row_number().over(Window.partitionBy("name", "abi").orderBy("step")))
    taken = r.where("abi AND k = 1").select("step").withColumn("place", F.row_number().over(Window.orderBy("step")))  # a row a name
    full = F.when(~F.col("abi"), "ABI").when(F.col("k") > 1, "DUPLICATE").when(F.col("place") > 192, "FULL").otherwise("OK")
    return r.join(taken, "step", "left").select("step", "name", full.alias("status"))


@query("src18_register_all", f"WITH {REGISTER} SELECT count(*) FILTER (abi AND k = 1) AS registered, count(*) FILTER (abi AND k > 1) AS already, min(step) FILTER (NOT abi) AS first_error FROM ranked")
def register_all(spark, sf):
    """All at once: names already there are no error, the first error is reported."""
    r = register(spark, sf)
    n = lambda s: F.count_if(F.col("status") == s)
    return r.agg((n("OK") + n("FULL")).alias("registered"), n("DUPLICATE").alias("already"), F.min(F.when(F.col("status") == "ABI", F.col("step"))).alias("first_error"))


#: Boot records written from fields that the part's number gives, many of them wrong in one.
_FIELDS = {"bytes_per_sector": (11, 2, "128 << (k % 7)"), "per_cluster": (13, 1, "[1, 2, 3, 4, 0, 8][1 + k % 6]"), "reserved": (14, 2, "CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END"), "fats": (16, 1, "1 + k % 5"), "root": (17, 2, "112 * (k % 4)"), "total": (19, 2, "720 * (1 + k % 5)"),
           "media": (21, 1, "232 + k % 24"), "per_fat": (22, 2, "k % 4"), "per_track": (24, 2, "9 * (k % 8)"), "heads": (26, 2, "k % 3")}
BOOT = "boot AS (SELECT id, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, (_, _, e) in _FIELDS.items()) + " FROM (SELECT p_partkey AS id, CAST((p_partkey * 7 + p_size) % 5040 AS INT) AS k FROM part))"
VALID = """valid_boot AS (SELECT *, bytes_per_sector BETWEEN 128 AND 4096 AND per_cluster IN (1, 2, 4, 8, 16, 32, 64, 128) AND reserved > 0 AND fats BETWEEN 1 AND 4 AND root > 0 AND total > 0 AND media >= 240 AND per_fat > 0 AND per_track BETWEEN 1 AND 63 AND heads BETWEEN 1 AND 255
  AND total * bytes_per_sector <= 10485760 AND reserved + fats * per_fat + (root * 32 + bytes_per_sector - 1) // bytes_per_sector < total
  AND (total - (reserved + fats * per_fat + (root * 32 + bytes_per_sector - 1) // bytes_per_sector)) // greatest(per_cluster, 1) > 0 AS valid FROM boot)"""


def _boot(spark, sf):
    """The records' fields, read little-endian from their bytes."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 5040).cast("int").alias("k"))
    text = {n: e.replace("128 << (k % 7)", "shiftleft(128, k % 7)").replace("[1, 2, 3, 4, 0, 8][1 + k % 6]", "get(array(1, 2, 3, 4, 0, 8), k % 6)") for n, (_, _, e) in _FIELDS.items()}
    parts = [F.lit("EB3C90" + "20" * 8)] + [octets.digits_little(F.expr(text[n]), size) for n, (_, size, _) in _FIELDS.items()]
    packed = p.select("id", F.rpad(F.concat(*parts), 1024, "0").alias("sector"))
    return packed.select("id", *[octets.little(F.col("sector"), at, size).alias(n) for n, (at, size, _) in _FIELDS.items()])


def _valid(spark, sf):
    c = F.col
    start = c("reserved") + c("fats") * c("per_fat") + F.expr("(root * 32 + bytes_per_sector - 1) div greatest(bytes_per_sector, 1)")
    power = lambda x: (c(x) > 0) & (c(x).bitwiseAND(c(x) - 1) == 0)
    ok = (c("bytes_per_sector").between(128, 4096) & power("bytes_per_sector") & power("per_cluster") & (c("reserved") > 0) & c("fats").between(1, 4) & (c("root") > 0) & (c("total") > 0) & (c("media") >= 0xF0) & (c("per_fat") > 0) & c("per_track").between(1, 63)
          & c("heads").between(1, 255) & (c("total") * c("bytes_per_sector") <= 10 * 1024 * 1024) & (start < c("total")) & (F.floor((c("total") - start) / F.greatest(c("per_cluster"), F.lit(1))) > 0))
    return _boot(spark, sf).withColumn("valid", ok)


@query("src22_validate_boot", f"WITH {BOOT}, {VALID} SELECT id, bytes_per_sector, per_cluster, total, valid FROM valid_boot")
def validate_boot(spark, sf):
    return _valid(spark, sf).select("id", "bytes_per_sector", "per_cluster", "total", "valid")


@query("src19_boot_candidates", f"""WITH {BOOT}, {VALID}, c AS (SELECT id, unnest([CASE WHEN valid THEN {{'name': 'FAT12', 'conf': 90}} END, CASE WHEN valid AND media = 249 THEN {{'name': 'ATARI_ST', 'conf': 92}} END, CASE WHEN NOT valid AND total > 0 THEN {{'name': 'CPM', 'conf': 40}} END, CASE WHEN bytes_per_sector = 512 AND total = 1440 THEN {{'name': 'PC_720', 'conf': 70}} END]) AS x FROM valid_boot)
  SELECT id, x.name AS system, x.conf AS confidence, row_number() OVER (PARTITION BY id ORDER BY x.conf DESC, x.name) AS rank FROM c WHERE x IS NOT NULL""")
def boot_candidates(spark, sf):
    """Systems that a boot record allows, best first."""
    one = lambda test, name, conf: F.when(test, F.struct(F.lit(name).alias("system"), F.lit(conf).alias("confidence")))
    v = F.col("valid")
    found = F.array_compact(F.array(one(v, "FAT12", 90), one(v & (F.col("media") == 249), "ATARI_ST", 92), one(~v & (F.col("total") > 0), "CPM", 40), one((F.col("bytes_per_sector") == 512) & (F.col("total") == 1440), "PC_720", 70)))
    c = _valid(spark, sf).select("id", F.explode(found).alias("x")).select("id", "x.*")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), "system")).cast("long"))


def _pick(values: list, k):
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


# Exact geometries (sector size, sectors, heads or 0 for any, cylinders, name), then ranges of total size.
_EXACT = [(512, 11, 2, 80, "AMIGA_DD"), (512, 22, 2, 80, "AMIGA_HD"), (512, 10, 2, 80, "CBM_1581"), (128, 26, 1, 77, "8_SSSD"), (128, 26, 2, 77, "8_DSDD"), (256, 26, 1, 77, "8_SSDD"), (256, 26, 2, 77, "8_DSDD"), (512, 9, 1, 40, "525_SSDD_40"), (512, 9, 2, 40, "525_DSDD_40"),
          (512, 9, 1, 80, "35_SSDD_80"), (512, 9, 2, 80, "35_DSDD_80"), (512, 15, 2, 80, "525_DSHD_80"), (512, 18, 2, 80, "35_DSHD_80"), (512, 36, 2, 80, "35_DSED_80")]
_RANGES = [(870000, 900000, "AMIGA_DD"), (350000, 370000, "525_DSDD_40"), (710000, 740000, "35_DSDD_80"), (1400000, 1480000, "35_DSHD_80")]
_SHAPE = {"ss": [512, 256, 128, 512, 512, 1024], "spt": [9, 11, 26, 18, 10, 36, 5, 15, 22], "heads": [1, 2, 2], "cyls": [80, 40, 77, 82]}
_CASE = " ".join(f"WHEN ss = {a} AND spt = {b} AND heads = {c} AND cyls = {d} THEN '{n}'" for a, b, c, d, n in _EXACT) + " " + " ".join(f"WHEN ss * spt * heads * cyls BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in _RANGES)


@query("src20_geometry", f"WITH g AS (SELECT o_orderkey AS id, {', '.join(f'{v}[CAST(1 + o_orderkey // {d} % {len(v)} AS BIGINT)] AS {n}' for d, (n, v) in zip((1, 6, 54, 162), _SHAPE.items(), strict=True))} FROM orders) SELECT id, CASE {_CASE} ELSE 'UNKNOWN' END AS geometry FROM g")
def geometry(spark, sf):
    """An exact geometry, else the range that the total size lies in."""
    k = F.col("o_orderkey")
    g = table(spark, sf, "orders").select(k.alias("id"), *[_pick(v, F.floor(k / d) % len(v)).cast("long").alias(n) for d, (n, v) in zip((1, 6, 54, 162), _SHAPE.items(), strict=True)])
    out = None
    for a, b, c, d, n in _EXACT:
        test = (F.col("ss") == a) & (F.col("spt") == b) & (F.col("heads") == c) & (F.col("cyls") == d)
        out = F.when(test, n) if out is None else out.when(test, n)
    for a, b, n in _RANGES:
        out = out.when((F.col("ss") * F.col("spt") * F.col("heads") * F.col("cyls")).between(a, b), n)
    return g.select("id", out.otherwise("UNKNOWN").alias("geometry"))


# Profiles by exact size of an image.
_PROFILES = [(901120, "AMIGA_DD"), (1802240, "AMIGA_HD"), (163840, "IBM_DD"), (184320, "IBM_DD"), (327680, "IBM_DD"), (368640, "IBM_DD"), (737280, "IBM_DD"), (1228800, "IBM_HD"), (1474560, "IBM_HD"), (2949120, "IBM_HD"), (1720320, "IBM_DMF"), (1763328, "IBM_DMF"), (1884160, "IBM_XDF"), (1900544, "IBM_XDF"),
             (1915904, "IBM_XDF"), (357376, "ATARI_ST_DD"), (714752, "ATARI_ST_DD"), (174848, "C64"), (175531, "C64"), (196608, "C64"), (349696, "C64"), (143360, "APPLE_DOS33"), (819200, "APPLE_PRODOS")]


@query("src24_profile_by_size", f"WITH {FILES}, g AS (SELECT * FROM (VALUES {', '.join(map(str, _PROFILES))}) AS t(size, profile)) SELECT id, coalesce(profile, 'UNKNOWN') AS profile FROM files LEFT JOIN g ON g.size = files.n")
def profile_by_size(spark, sf):
    g = spark.createDataFrame(_PROFILES, "length long, profile string")
    return _id(_files(spark, sf).join(F.broadcast(g), "length", "left").select("path", F.coalesce("profile", F.lit("UNKNOWN")).alias("profile")))


_SYNCS = [0x4489, 0x9521, 0xD5AA96, 0x52FF, 0x1234, 0xA245, 0x4489, 0xFF52]
PLATFORM = f"p AS (SELECT o_orderkey AS id, {_SYNCS}[CAST(1 + o_orderkey % 8 AS BIGINT)] AS sync, [11, 22, 9, 18, 5][CAST(1 + o_orderkey // 8 % 5 AS BIGINT)] AS n, 6000 + o_orderkey * 37 % 22000 AS len FROM orders)"


@query("src25_platform", f"""WITH {PLATFORM} SELECT id, CASE WHEN sync = 17545 AND n = 11 AND len BETWEEN 11000 AND 14000 THEN 'AMIGA' WHEN sync = 17545 AND n = 22 AND len BETWEEN 22000 AND 28000 THEN 'AMIGA' WHEN sync = 17545 AND n = 9 AND len BETWEEN 6000 AND 7000 THEN 'IBM_PC'
  WHEN sync = 17545 AND n = 18 AND len BETWEEN 12000 AND 14000 THEN 'IBM_PC' WHEN sync IN (38177, 41541, 43162) THEN 'AMIGA' WHEN (sync & 16776960) = 14002688 THEN 'APPLE_II' WHEN sync IN (21247, 65362) THEN 'C64' ELSE 'UNKNOWN' END AS platform FROM p""")
def platform(spark, sf):
    """Sync word, sectors and length of a track say which machine wrote it."""
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select(k.alias("id"), _pick(_SYNCS, k % 8).alias("sync"), _pick([11, 22, 9, 18, 5], F.floor(k / 8) % 5).alias("n"), (k * 37 % 22000 + 6000).alias("len"))
    rows = [(11, 11000, 14000, "AMIGA"), (22, 22000, 28000, "AMIGA"), (9, 6000, 7000, "IBM_PC"), (18, 12000, 14000, "IBM_PC")]
    out = F.when(F.lit(False), "")
    for n, lo, hi, name in rows:
        out = out.when((F.col("sync") == 0x4489) & (F.col("n") == n) & F.col("len").between(lo, hi), name)
    out = out.when(F.col("sync").isin(0x9521, 0xA245, 0xA89A), "AMIGA").when(F.col("sync").bitwiseAND(0xFFFF00) == 0xD5AA00, "APPLE_II").when(F.col("sync").isin(0x52FF, 0xFF52), "C64")
    return p.select("id", out.otherwise("UNKNOWN").alias("platform"))


# Targets with their base score and what they can hold: flux, timing, protection, weak bits, fit for archives.
_TARGETS = [("SCP", 0.6, True, True, True, True, True), ("HFE", 0.5, False, True, False, False, False), ("G64", 0.5, False, True, True, True, False), ("IPF", 0.55, False, True, True, True, True), ("IMG", 0.5, False, False, False, False, False), ("ADF", 0.5, False, False, False, False, False)]
_TARGETS_SQL = ", ".join("(" + ", ".join([repr(t[0]), str(t[1]), *(str(x).lower() for x in t[2:])]) + ")" for t in _TARGETS)


@query("src26_suggestion", f"""WITH f AS (SELECT * FROM (VALUES {_TARGETS_SQL}) AS t(format, base, flux, timing, prot, weak, archive)), d AS (SELECT c_custkey AS path, c_custkey % 3 = 0 AS has_flux, c_acctbal > 5000 AS protected, c_nationkey % 2 = 0 AS has_weak, CASE c_custkey % 4 WHEN 0 THEN 'IMG' WHEN 1 THEN 'ADF' END AS native, c_custkey % 5 < 2 AS archival FROM customer),
  s AS (SELECT path, format, round(least(1.0::DOUBLE, greatest(0.0, base + CASE WHEN has_flux THEN CASE WHEN flux THEN 0.15 WHEN NOT timing THEN -0.2 ELSE 0 END ELSE 0 END + CASE WHEN protected THEN CASE WHEN prot THEN 0.2 ELSE -0.3 END ELSE 0 END + CASE WHEN has_weak THEN CASE WHEN weak THEN 0.15 ELSE -0.25 END ELSE 0 END
  + CASE WHEN native = format THEN 0.1 ELSE 0 END + CASE WHEN archival THEN CASE WHEN archive THEN 0.1 ELSE -0.1 END ELSE CASE WHEN archive THEN -0.05 ELSE 0.05 END END)), 6) AS score FROM d, f) SELECT path, format, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, format) AS rank FROM s""")
def suggestion(spark, sf):
    """Targets ranked for each source: base score with all adjustments, held to 0..1."""
    f = F.broadcast(spark.createDataFrame(_TARGETS, "format string, base double, flux boolean, timing boolean, prot boolean, weak boolean, archive boolean"))  # six rows
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(k.alias("path"), (k % 3 == 0).alias("has_flux"), (F.col("c_acctbal") > 5000).alias("protected"), (F.col("c_nationkey") % 2 == 0).alias("has_weak"),
                                            F.when(k % 4 == 0, "IMG").when(k % 4 == 1, "ADF").alias("native"), (k % 5 < 2).alias("archival"))
    pick = lambda c, a, b: F.when(F.col(c), a).otherwise(b)
    only = lambda c, x: F.when(F.col(c), x).otherwise(0.0)
    score = (F.col("base") + only("has_flux", F.when(F.col("flux"), 0.15).when(~F.col("timing"), -0.2).otherwise(0.0)) + only("protected", pick("prot", 0.2, -0.3)) + only("has_weak", pick("weak", 0.15, -0.25))
             + F.when(F.col("native") == F.col("format"), 0.1).otherwise(0.0) + F.when(F.col("archival"), pick("archive", 0.1, -0.1)).otherwise(pick("archive", -0.05, 0.05)))
    s = d.crossJoin(f).select("path", "format", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "format")).cast("long"))


@query("src27_triage", f"""WITH {FLUX}, b AS (SELECT min(track) AS lo, max(track) AS hi FROM flux), t AS (SELECT track, count(*) AS n, avg(CASE WHEN label <> 'error' THEN 1.0 ELSE 0.0 END) AS ok, least(1.0, stddev_pop(amp) / nullif(avg(abs(amp)), 0)) AS spread FROM flux, b WHERE track IN (lo, hi, (lo + hi) // 2) GROUP BY track),
  q AS (SELECT track, round(70 * ok + 30 * (1 - coalesce(spread, 1.0)), 4) AS quality FROM t) SELECT track, quality, CASE WHEN quality >= 80 THEN 'GREEN' WHEN quality >= 50 THEN 'YELLOW' WHEN quality > 0 THEN 'RED' ELSE 'WHITE' END AS grade FROM q""")
def triage(spark, sf):
    """First, middle and last track: quality from readable samples and their spread, then a colour."""
    f = flux(spark, sf)
    b = f.agg(F.min("track").alias("lo"), F.max("track").alias("hi"))  # one row
    t = f.join(F.broadcast(b), (F.col("track") == F.col("lo")) | (F.col("track") == F.col("hi")) | (F.col("track") == F.expr("(lo + hi) div 2")))
    spread = F.least(F.lit(1.0), F.stddev_pop("amp") / F.nullif(F.avg(F.abs("amp")), F.lit(0.0)))
    q = t.groupBy("track").agg(F.round(F.avg((F.col("label") != "error").cast("double")) * 70 + (1 - F.coalesce(spread, F.lit(1.0))) * 30, 4).alias("quality"))
    return q.select("track", "quality", F.when(F.col("quality") >= 80, "GREEN").when(F.col("quality") >= 50, "YELLOW").when(F.col("quality") > 0, "RED").otherwise("WHITE").alias("grade"))


@query("io18_validate_image", f"""WITH {WHOLE}, {_SPECS}, x AS (SELECT ext, format, reg, sizes FROM (SELECT unnest(exts) AS ext, format, reg, sizes FROM specs)),
  c AS (SELECT f.id, coalesce(x.format, k.format) AS format, coalesce(x.reg, k.reg) AS reg, x.format IS NOT NULL AND list_contains(sizes, n) AS exact, x.format IS NOT NULL AND len(sizes) = 0 AS any_size, k.format IS NOT NULL AS claimed, coalesce(k.conf, 0) AS conf
    FROM files f LEFT JOIN x ON x.ext = lower(f.ext) LEFT JOIN claims k ON k.id = f.id AND k.format = x.format),
  e AS (SELECT id, arg_min(format, reg) FILTER (exact AND claimed) AS a, arg_min(format, reg) FILTER (any_size AND claimed) AS b FROM c GROUP BY id), m AS (SELECT id, arg_max(format, conf * 100 - reg) AS m FROM claims GROUP BY id)
  SELECT e.id, coalesce(a, b, m) AS format, coalesce(a, b, m) IS NOT NULL AS valid, CASE WHEN a IS NOT NULL THEN 'SIZE' WHEN b IS NOT NULL THEN 'EXTENSION' WHEN m IS NOT NULL THEN 'CONTENT' ELSE 'NONE' END AS how FROM e LEFT JOIN m ON m.id = e.id""")
def validate_image(spark, sf):
    """A format that the extension names and the content bears out, first by an exact length, then of any length; else what the content alone says."""
    files = _files(spark, sf)
    by = F.broadcast(_specs(spark).select("format", F.explode("exts").alias("low"), "sizes"))
    named = files.select("path", "length", F.lower(F.substring_index("path", ".", -1)).alias("low")).join(by, "low").drop("low")
    c = pr.claims(files, window=None).join(named, ["path", "format"], "left")
    first = lambda test: F.min_by(F.when(test, F.col("format")), F.when(test, F.col("reg")))
    e = c.groupBy("path").agg(first(F.array_contains("sizes", F.col("length"))).alias("a"), first(F.size("sizes") == 0).alias("b"), F.max_by("format", F.struct("conf", -F.col("reg"))).alias("m"))
    how = F.when(F.col("a").isNotNull(), "SIZE").when(F.col("b").isNotNull(), "EXTENSION").when(F.col("m").isNotNull(), "CONTENT").otherwise("NONE")
    got = files.select("path").join(e, "path", "left")
    return _id(got.select("path", F.coalesce("a", "b", "m").alias("format"), F.coalesce("a", "b", "m").isNotNull().alias("valid"), how.alias("how")))
