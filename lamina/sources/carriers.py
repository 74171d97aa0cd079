"""The recorded-media shapes that operators work on, read from the star-schema tables.

flux: one row for each interval of a track (a user's events in time order), sectors: repeated reads of a
track's sectors (an order's lines), samples: traces of amplitudes (embedding vectors), images: raw bytes in
fixed chunks (documents)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import octets
from ..operators import codec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, idx (from 0), dt (microseconds since the last; null first), amp, label."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("idx"),
        (at - F.lag(at).over(order)).alias("dt"), F.col("value").alias("amp"), F.col("event_type").alias("label"))


FLUX = """flux AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt, value AS amp, event_type AS label FROM events)"""


#: What orders the reads of one sector.
READ_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, sector, data, quality, crc_ok, weak, deleted: reads of sectors without their number, and the columns of READ_ORDER."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("sector"), F.col("l_partkey").alias("data"), F.col("l_quantity").alias("quality"),
        (F.col("l_returnflag") != "R").alias("crc_ok"), (F.col("l_linestatus") == "O").alias("weak"), (F.col("l_returnflag") == "A").alias("deleted"), *READ_ORDER)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, sector, read (from 0), data, crc_ok, weak, deleted: reads of one sector in a fixed order."""
    order = Window.partitionBy("track", "sector").orderBy(*READ_ORDER)  # by the columns that callers group by: one shuffle serves both
    return lines(spark, sf_dir).select("track", "sector", (F.row_number().over(order) - 1).cast("long").alias("read"), "data", "quality", "crc_ok", "weak", "deleted")


SECTORS = """sectors AS (SELECT l_orderkey AS track, CAST(l_linenumber AS BIGINT) AS sector,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS read,
  l_partkey AS data, l_quantity AS quality, l_returnflag <> 'R' AS crc_ok, l_linestatus = 'O' AS weak, l_returnflag = 'A' AS deleted FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace, label, idx (from 0), amp."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trace"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("idx", "amp")).select(
        "trace", "label", F.col("idx").cast("long").alias("idx"), F.col("amp").cast("double").alias("amp"))


SAMPLES = """samples AS (SELECT vec_id AS trace, CAST(label AS BIGINT) AS label, CAST(i - 1 AS BIGINT) AS idx, CAST(embedding[i] AS DOUBLE) AS amp
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))"""


def _chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """image, chunk (from 0), data: bytes of a text, size a chunk; each byte is cut out once."""
    raw = F.encode("text", "utf-8")
    n = F.octet_length("text")
    chunks = octets.once(raw, lambda r: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda c: F.substring(r, c * size + 1, F.lit(size))))
    return table(spark, sf_dir, "documents").where("octet_length(text) > 0").select(F.col("doc_id").alias("image"), F.posexplode(chunks).alias("chunk", "data")).select(
        "image", F.col("chunk").cast("long").alias("chunk"), "data")


def images(spark: SparkSession, sf_dir: str, size: int = 256, form: str = "hex") -> DataFrame:
    """image, chunk (from 0), size bytes as hexadecimal digits or as bytes."""
    chunks = _chunks(spark, sf_dir, size)
    return chunks if form == "bytes" else chunks.withColumn("data", F.hex("data"))


IMAGES = """raws AS (SELECT doc_id AS image, hex(encode(text)) AS raw FROM documents WHERE length(text) > 0),
images AS (SELECT image, c AS chunk, substr(raw, c * 512 + 1, 512) AS data FROM raws, unnest(range(0, CAST(floor((length(raw) - 1) / 512) AS BIGINT) + 1)) AS u(c))"""


def noise(spark: SparkSession, sf_dir: str, size: int = 256, form: str = "hex") -> DataFrame:
    """image, chunk, data: the images' bytes mixed so that all 256 values occur (zero and 0xE5 marks among them), as digits, bits or bytes."""
    number = lambda c: c.fill_null(0).to_numpy(zero_copy_only=False)

    def mix(batches):
        for b in batches:
            raw, at = codec.flat(b.column(2))
            mixed = (raw.astype(np.int64) * 37 + np.repeat(number(b.column(0)) * 11 + number(b.column(1)), np.diff(at))) % 256
            mixed = mixed.astype(np.uint8)
            data = {"hex": lambda: codec.strings(codec.digits(mixed), at * 2), "bits": lambda: codec.strings(np.unpackbits(mixed) + 48, at * 8), "bytes": lambda: codec.strings(mixed, at, pa.binary())}[form]()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data], names=["image", "chunk", "data"])

    return _chunks(spark, sf_dir, size).mapInArrow(mix, f"image long, chunk long, data {'binary' if form == 'bytes' else 'string'}")


NOISE = f"""{IMAGES}, noise AS (SELECT image, chunk, array_to_string([printf('%02X', (b * 37 + image * 11 + chunk) % 256) FOR b IN {octets.sql_values("data")}], '') AS data FROM images)"""


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, idx (from 0), dt (nanoseconds): intervals of 2, 3 or 4 cells of 2,000 ns with up to 200 ns of jitter."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cells = F.floor(F.abs("value")) % 3 + 2
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (cells * 2000 + F.col("event_id") * 7919 % 401 - 200).alias("dt"))


PULSES = """pulses AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  (CAST(floor(abs(value)) AS BIGINT) % 3 + 2) * 2000 + event_id * 7919 % 401 - 200 AS dt FROM events)"""


def turns(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """track, sector (from 0), data: a conversation's turns cut into sectors of size bytes, as digits, the last ones filled up."""
    raw = F.encode("text", "utf-8")
    chunks = octets.once(raw, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / size).cast("int")), lambda c: F.substring(r, c * size + 1, F.lit(size))))
    cut = table(spark, sf_dir, "conversations").where("octet_length(text) > 0").select("conv_id", "turn", F.posexplode(chunks).alias("chunk", "data"))
    order = Window.partitionBy("conv_id").orderBy("turn", "chunk")
    return cut.select(F.col("conv_id").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("sector"), F.rpad(F.hex("data"), 2 * size, "0").alias("data"))


def turns_sql(size: int, name: str = "turns") -> str:
    return f"""{name} AS (SELECT conv_id AS track, row_number() OVER (PARTITION BY conv_id ORDER BY turn, c) - 1 AS sector, rpad(substr(raw, CAST(c * {2 * size} + 1 AS BIGINT), {2 * size}), {2 * size}, '0') AS data
  FROM (SELECT conv_id, turn, hex(encode(text)) AS raw FROM conversations WHERE length(text) > 0), unnest(range(0, (length(raw) - 1) // {2 * size} + 1)) AS u(c))"""
