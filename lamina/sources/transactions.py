"""Transactions on tables of images: pending writes go to new files, a manifest names what is live, and a commit is one rename.

A store is a folder. `files/<name>` holds the sectors that one transaction wrote and is never changed; `manifests/<number>` is a table of (disk,
sector, name), one row a live sector; the highest number is the current one. A commit writes its sectors and a whole new
manifest under names that nobody reads and then renames the manifest to the next number. What fails before that leaves the
old manifest as it was; of two commits from one manifest the second finds the number taken. Old manifests stay, so a backup is a number, and restoring it is
another commit.

Defined cases: a second pending write of a sector is a conflict and is not staged (the first by step stays); writes go out last first and
stop at the first that fails; with a backup nothing of a disk stays then (ROLLED_BACK), without one what was written
before does (PARTIAL); a disk whose mode is not supported keeps what it has (NOT_SUPPORTED); an empty transaction commits nothing new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IN_MEMORY, BACKUP, SHADOW = "IN_MEMORY", "BACKUP", "SHADOW_WRITE"
_MANIFEST = "disk long, sector long, name string"


class Taken(RuntimeError):
    """Another commit has taken the number."""


class Store:
    """A folder of files and manifests that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str, schema: str = "disk long, sector long, data double"):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.sc().hadoopConfiguration()

    def _path(self, part: str):
        return self._jvm.Path(f"{self.root}/{part}")

    def versions(self) -> list[int]:
        """Numbers of the manifests, the current one last."""
        at = self._path("manifests")
        store = at.getFileSystem(self._conf)
        if not store.exists(at):
            return []
        return sorted(int(name) for f in store.listStatus(at) if (name := f.getPath().getName()).isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """disk, sector, name of what is live; the current manifest by default."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{have[-1] if version is None else version}")

    def read(self, version: int | None = None) -> DataFrame:
        """The live sectors: files are read where the manifest names them."""
        live = self.manifest(version)
        if not self.versions():
            return self.spark.createDataFrame([], self.schema)
        files = self.spark.read.schema(f"{self.schema}, name string").option("basePath", f"{self.root}/files").parquet(f"{self.root}/files")
        return files.join(live, ["disk", "sector", "name"]).drop("name")

    def _publish(self, manifest: DataFrame, seen: int) -> int:
        """Write a manifest aside and rename it to the number behind the one that was seen."""
        aside = f"manifests/_{uuid.uuid4().hex}"  # names that begin so are not numbers
        manifest.write.parquet(f"{self.root}/{aside}")
        context = self._jvm.FileContext.getFileContext(self._path("").toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 0)  # never onto what exists
        try:
            context.rename(self._path(aside), self._path(f"manifests/{seen + 1}"), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Taken(f"manifest {seen + 1} exists") from None
            raise
        return seen + 1

    def write(self, sectors: DataFrame) -> int:
        """Commit (disk, sector, data) rows over what is live, whole or not at all; the new manifest's number."""
        have = self.versions()
        seen, name = (have[-1] if have else 0), uuid.uuid4().hex
        sectors.write.parquet(f"{self.root}/files/name={name}")
        new = self.spark.read.parquet(f"{self.root}/files/name={name}").select("disk", "sector", F.lit(name).alias("name"))
        old = self.manifest(seen if have else None).join(new.select("disk", "sector"), ["disk", "sector"], "left_anti")
        return self._publish(old.unionByName(new), seen)

    def restore(self, version: int) -> int:
        """Make an older manifest the current one; nothing is copied but the manifest."""
        return self._publish(self.manifest(version), self.versions()[-1])


class Transaction:
    """Pending writes (disk, sector, step, data, fails, mode): staged at once, committed or given up later."""

    def __init__(self, store: Store, writes: DataFrame):
        self.store, self.backup = store, (store.versions() or [0])[-1]
        self.path = f"{store.root}/staged/{uuid.uuid4().hex}"
        first = Window.partitionBy("disk", "sector").orderBy("step")
        writes.withColumn("conflict", F.row_number().over(first) > 1).write.parquet(self.path)

    def pending(self) -> DataFrame:
        return self.store.spark.read.parquet(self.path)

    def begun(self) -> DataFrame:
        """disk, mode, pending, conflicts as they are staged."""
        supported = F.col("mode").isin(IN_MEMORY, BACKUP)
        by = self.pending().groupBy("disk", "mode").agg(F.count_if(~F.col("conflict")).alias("pending"), F.count_if("conflict").alias("conflicts"))
        return by.select("disk", F.when(supported, F.col("mode")).otherwise("NOT_SUPPORTED").alias("mode"), F.when(supported, F.col("pending")).otherwise(0).alias("pending"), F.when(supported, F.col("conflicts")).otherwise(0).alias("conflicts"))

    def _ordered(self) -> DataFrame:
        """The staged writes with their place, last first, and the place of their disk's first failure."""
        disk = Window.partitionBy("disk")
        live = self.pending().where(~F.col("conflict") & F.col("mode").isin(IN_MEMORY, BACKUP))
        k = live.withColumn("k", F.row_number().over(disk.orderBy(F.desc("step"))))
        return k.withColumn("stop", F.min(F.when(F.col("fails"), F.col("k"))).over(disk))

    def commit(self) -> DataFrame:
        """Write what goes out; disk, state, and how many of its live sectors the new manifest takes from this transaction."""
        out = F.col("stop").isNull() | ((F.col("k") < F.col("stop")) & (F.col("mode") == IN_MEMORY))
        version = self.store.write(self._ordered().where(out).select("disk", "sector", "data"))
        took = self.store.manifest(version).join(self.store.manifest(self.backup) if self.backup else self.store.manifest(version).limit(0), ["disk", "sector", "name"], "left_anti")
        state = F.when(~F.col("mode").isin(IN_MEMORY, BACKUP), "NOT_SUPPORTED").when(~F.col("failed"), "COMMITTED").when(F.col("mode") == BACKUP, "ROLLED_BACK").otherwise("PARTIAL")
        by = self.pending().groupBy("disk", "mode").agg(F.coalesce(F.bool_or(F.col("fails") & ~F.col("conflict")), F.lit(False)).alias("failed"))
        written = took.groupBy("disk").agg(F.count("*").alias("written"))
        return by.join(written, "disk", "left").select("disk", state.alias("state"), F.coalesce("written", F.lit(0)).alias("written"))

    def rollback(self) -> int:
        """Give up: what was live before the transaction began is live again."""
        return self.store.restore(self.backup) if self.store.versions()[-1:] != [self.backup] else self.backup
