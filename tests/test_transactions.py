"""The manifest store: commits killed in the middle, conflicts, order, backups."""

import pytest
from pyspark.sql import functions as F

from lamina.sources import transactions as tx

WRITES = "disk long, sector long, step long, data double, fails boolean, mode string"


@pytest.fixture
def store(spark, tmp_path):
    s = tx.Store(spark, f"file://{tmp_path}/store")
    assert s.read().count() == 0 and s.versions() == []
    s.write(spark.createDataFrame([(d, k, -1.0) for d in range(4) for k in range(4)], s.schema))
    return s


def content(store, version=None):
    return {(r["disk"], r["sector"]): r["data"] for r in store.read(version).collect()}


def test_a_commit_that_is_killed_leaves_the_old_image(spark, store, monkeypatch):
    before = content(store)
    new = spark.createDataFrame([(0, 0, 5.0), (9, 1, 6.0)], store.schema)
    boom = new.withColumn("data", F.raise_error(F.lit("killed")).cast("double"))
    with pytest.raises(Exception, match="killed"):
        store.write(boom)  # while sectors are written
    assert content(store) == before and store.versions() == [1]
    monkeypatch.setattr(tx.Store, "_path", lambda self, part, real=tx.Store._path: (_ for _ in ()).throw(RuntimeError("killed")) if part.startswith("manifests/_") else real(self, part))
    with pytest.raises(RuntimeError, match="killed"):
        store.write(new)  # between the manifest and its rename
    monkeypatch.undo()
    assert content(store) == before and store.versions() == [1]
    assert store.write(new) == 2
    assert content(store) == before | {(0, 0): 5.0, (9, 1): 6.0} and content(store, 1) == before


def test_two_commits_from_one_manifest(spark, store):
    one = spark.createDataFrame([(0, 0, 1.0)], store.schema)
    old = store.manifest()
    store.write(one)
    with pytest.raises(tx.Taken):
        store._publish(old, 1)
    assert content(store)[0, 0] == 1.0 and store.versions() == [1, 2]


def test_order_states_and_conflicts(spark, store):
    rows = [
        (0, 0, 1, 10.0, False, "IN_MEMORY"), (0, 1, 2, 11.0, True, "IN_MEMORY"), (0, 2, 3, 12.0, False, "IN_MEMORY"),  # the last goes first, then one fails
        (1, 0, 1, 20.0, True, "BACKUP"), (1, 1, 2, 21.0, False, "BACKUP"),
        (2, 0, 1, 30.0, False, "BACKUP"), (2, 0, 2, 31.0, True, "BACKUP"),  # a conflict is not staged, nor can it fail
        (3, 0, 1, 40.0, False, "SHADOW_WRITE"), (3, 0, 2, 41.0, False, "SHADOW_WRITE"),
    ]
    one = tx.Transaction(store, spark.createDataFrame(rows, WRITES))
    assert sorted(map(tuple, one.begun().collect())) == [(0, "IN_MEMORY", 3, 0), (1, "BACKUP", 2, 0), (2, "BACKUP", 1, 1), (3, "NOT_SUPPORTED", 0, 0)]
    assert store.versions() == [1]
    assert sorted(map(tuple, one.commit().collect())) == [(0, "PARTIAL", 1), (1, "ROLLED_BACK", 0), (2, "COMMITTED", 1), (3, "NOT_SUPPORTED", 0)]
    changed = {k: v for k, v in content(store).items() if v != -1.0}
    assert changed == {(0, 2): 12.0, (2, 0): 30.0}
    one.rollback()
    assert set(content(store).values()) == {-1.0} and store.versions() == [1, 2, 3]


def test_an_empty_transaction(spark, store):
    before = content(store)
    one = tx.Transaction(store, spark.createDataFrame([], WRITES))
    assert one.begun().count() == 0 and one.commit().count() == 0 and content(store) == before
