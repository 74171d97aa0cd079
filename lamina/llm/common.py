"""Helpers shared by the corpus operators: shared storage, word cutting, Arrow maps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: Rows of texts that a task works on at a time; Spark bounds its own batches by bytes.
BATCH_ROWS = 1000
#: Rows of a narrow table (tens of bytes a row) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: A-Z to a-z, every other byte as it is.
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)
#: As LOWER_TABLE, and every ASCII byte that is no letter or digit becomes a space.
WORD_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``; bytes.split() cuts at exactly these six bytes."""
    return text.translate(LOWER_TABLE).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(WORD_TABLE).split()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder that the driver and all executors reach.

    It lies in spark.checkpoint.dir; only where that is unset and all runs on one machine (tests) a local
    folder is made and set as the checkpoint folder. On a cluster an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local"):
            base = f"file://{tempfile.gettempdir()}/checkpoints"
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives the loss of executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() made; nothing that is still to be read may come from them."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.sc().hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast where its counted rows are within the bound;
    beyond it Spark shuffles both sides."""
    return F.broadcast(table) if table.count() <= rows else table


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of whole texts in parts of BATCH_ROWS rows: what a task makes of one part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What an operator remembers between the tasks of a reused Python worker. A worker keeps it for one
    operator at a time: a session that runs several needs no more memory than the one that needs most."""
    if owner not in _held:
        if _held:
            _held.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
        _held[owner] = {}
    return _held[owner]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers), element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n values in a row."""
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return acc
