"""The data source of flux images: a filter on tracks reads only their bytes."""

import numpy as np
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from lamina.sources import containers as c

TICKS = {no: np.arange(50, 3050 + no) * (40 if no == 7 else 1) for no in (0, 3, 7, 100)}


class Counting:
    """A file system that counts the bytes read."""

    def __init__(self, store):
        self.store, self.read = store, 0

    def get_file_info(self, path):
        return self.store.get_file_info(path)

    def open_input_file(self, path):
        outer, file = self, self.store.open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                file.close()

            def size(self):
                return file.size()

            def read_at(self, n, at):
                outer.read += n
                return file.read_at(n, at)

        return File()


def test_a_filter_reads_only_its_tracks(tmp_path, monkeypatch):
    path = tmp_path / "a.scp"
    path.write_bytes(c.flux_image({no: c.encode_transitions(t) for no, t in TICKS.items()}))
    from pyarrow import fs

    store = Counting(fs.LocalFileSystem())
    monkeypatch.setattr(c.FluxImageReader, "_open", lambda self: (store, str(path)))
    reader = c.PushedFluxImageReader(str(path))
    assert list(reader.pushFilters([EqualTo(("track",), 3), GreaterThan(("idx",), 5)])) == [GreaterThan(("idx",), 5)]
    parts = reader.partitions()
    got = [b for p in parts for b in reader.read(p)]
    assert len(parts) == 1 and got[0].column("ticks").to_pylist() == TICKS[3].tolist()
    assert store.read == c.TABLE_AT + 4 * c.TABLE_TRACKS + 16 + 2 * len(TICKS[3])
    both = c.PushedFluxImageReader(str(path))
    list(both.pushFilters([In(("track",), (3, 7, 9)), EqualTo(("track",), 7)]))
    assert [p.number for p in both.partitions()] == [7]


def test_the_source_in_spark(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    whole = c.flux_image({no: c.encode_transitions(t) for no, t in TICKS.items()})
    (folder / "a.scp").write_bytes(whole)
    (folder / "cut.scp").write_bytes(whole[: len(whole) - 1000])
    (folder / "none.scp").write_bytes(b"")
    (folder / "other.scp").write_bytes(b"HFE" + bytes(2000))
    spark.dataSource.register(c.FluxImageSource)
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        for pushed in ("false", "true"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
            df = spark.read.format("flux_image").option("push", pushed).load(f"file://{folder}").where("path LIKE '%/a.scp'")
            got = {no: [r["ticks"] for r in df.where(f"track = {no}").orderBy("idx").collect()] for no in (3, 7, 8)}
            assert got[3] == TICKS[3].tolist() and got[8] == []
            assert [t for t in got[7] if t] == TICKS[7].tolist()
            both = spark.read.format("flux_image").option("push", pushed).load(f"file://{folder}").where("track IN (0, 100)").groupBy("path", "track").count().collect()
            assert {(r["path"].rsplit("/", 1)[1], r["track"]): r["count"] for r in both} == {("a.scp", 0): 3000, ("a.scp", 100): 3100, ("cut.scp", 0): 3000, ("cut.scp", 100): 2600}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)
