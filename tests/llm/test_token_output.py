import random
import zlib

import numpy as np
import pytest

from lamina.llm import token_output as to
from lamina.llm.common import shared_dir
from lamina.llm.encoding import encoder, tokenizer, vocabulary_path

from .conftest import odd_rows

PATH = vocabulary_path()


def library(text):
    return tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_whole_texts(docs):
    texts = [r["text"] for r in docs.collect()] + [
        "a  b", "  a", "a \n b", "\n a", "a\n  b ", "", " ", "a ", "x<|endoftext|> y", "　 a", "a  b", "don't  we'll 123  4", "\0a",
        " \0x", "a \0x", None, "a ​ b", "x" * 5000, "\n\n\n  \t x", "ab.\ncd, ef!\ngh\n ij.\n", "a.\n.b \nc d\n\ne f.,", "x's.\n's\n't,", "a\nb\nc\n\td.", "\na.", "é,\nÉ: ß! 中.\n中",
        "".join(random.Random(4).choices(["a", "b ", ".", ",", "\n", " ", "'s", "1", "é"], k=3000))]
    enc = encoder(PATH)
    assert [x.tolist() for x in enc.encode(texts)] == [library(t) for t in texts]
    assert enc.counts(texts).tolist() == [len(library(t)) for t in texts]


def expected(rows):
    out, at = [], 0
    for doc, text in rows:
        ids = np.array([*library(text), 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_round_trip(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, to.token_output(docs).collect())) == expected(rows)


def test_shards_index_and_lookup(spark, docs):
    path = shared_dir(spark, "shards")
    to.write_shards(docs, path, PATH, shard_ids=5000)
    assert spark.read.parquet(path).count() > 20
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, to.read_documents(spark, path).collect())) == expected(rows)
    keys = spark.createDataFrame([(3,), (50,), (10**9,), (None,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in to.lookup(spark, path, keys).collect()}
    assert got == {k: [*library(dict(rows)[k]), 2] for k in (3, 50)}


def test_lookup_opens_only_parts_and_shards_that_may_hold_a_key(spark, docs):
    path = shared_dir(spark, "shards")
    to.write_shards(docs, path, PATH, shard_ids=5000)
    shards = spark.read.parquet(path).select("part", "shard", "lo", "hi").collect()
    assert len({r["part"] for r in shards}) > 1
    key = max(r["lo"] for r in shards)
    got = to.lookup(spark, path, spark.createDataFrame([(key,)], "doc_id long"))
    part = next(r["part"] for r in shards if r["lo"] == key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "payload" in x and "FileScan" in x)
    assert f"= {part})" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert f"{key}" in scan.split("PushedFilters: [")[1].split("]")[0]
    assert [r["doc_id"] for r in got.collect()] == [key]


def test_repeated_and_missing_keys(spark):
    rows = [(i // 3 * 2, f"text {i} " * (i % 5 + 1)) for i in range(90)] + [(None, "nobody")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = shared_dir(spark, "shards")
    to.write_shards(df, path, PATH, shard_ids=12)
    firsts = {}
    for r in to.read_documents(spark, path).collect():
        if r["doc_id"] is not None and (r["doc_id"] not in firsts or r["start"] < firsts[r["doc_id"]][0]):
            firsts[r["doc_id"]] = (r["start"], r["ids_crc32"])
    got = to.lookup(spark, path, spark.createDataFrame([(k,) for k in range(-3, 70)], "doc_id long")).collect()
    assert len(got) == len(firsts) == 30
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == firsts[r["doc_id"]][1] for r in got)
    assert to.lookup(spark, path, df.limit(0)).count() == 0


def test_the_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    displace, slot = to.build_mph(keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    assert (to.slots(keys, displace, len(keys)) == slot).all()


def test_odd_rows(odd_extra, empty):
    got = sorted(map(tuple, to.token_output(odd_extra).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in odd_rows()), key=lambda d: (d is not None, d or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert at == sum(len(library(r[1])) + 1 for r in odd_rows())
    assert to.token_output(empty).count() == 0


def test_a_wrong_fingerprint_is_an_error(spark, docs, monkeypatch):
    path = shared_dir(spark, "shards")
    to.write_shards(docs.where("doc_id < 20"), path, PATH)
    from pyspark.sql import functions as F

    other = shared_dir(spark, "shards")
    spark.read.parquet(path).withColumn("prints", F.transform("prints", lambda x: x.bitwiseXOR(F.lit(1)))).write.partitionBy("part").parquet(other)
    with pytest.raises(Exception, match="fingerprint"):
        to.read_documents(spark, other).collect()
