import math
import re
import zlib

from pyspark.sql import functions as F

from lamina.llm import language_id as li


def test_held_out_accuracy(docs):
    got = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and right / n > 0.93


def test_accuracy_of_each_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    for r in got.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).collect():
        assert r["n"] < 10 or r["right"] / r["n"] > 0.9, r


def slow_grams(text):
    """Bucket counts of a text's subwords, one n-gram at a time."""
    if not any(c.isalpha() for c in text):
        return None
    out = {}
    raw = (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode("utf-8", "replace")
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if 32 in gram[1:-1]:
                continue
            h = 0x9E37 + n
            for b in gram:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
            out[h % li.BUCKETS] = out.get(h % li.BUCKETS, 0) + 1
    return out


def test_predictions_equal_a_slow_forward_pass(docs):
    model = li.train(docs)
    table = model["logits"].tolist()
    got = {r["doc_id"]: r for r in li.predict(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        grams = slow_grams(r["text"]) if r["text"] else None
        mine = got[r["doc_id"]]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if grams is None:
            assert mine["lang_pred"] == "und" and mine["score"] == 0
            continue
        total = sum(grams.values())
        z = [sum(n * table[b][k] for b, n in grams.items()) / total / model["temperature"] for k in range(len(model["langs"]))]
        e = [math.exp(x - max(z)) for x in z]
        assert mine["lang_pred"] == model["langs"][z.index(max(z))] and abs(mine["score"] - max(e) / sum(e)) < 1e-3


def test_training_does_not_depend_on_the_order_of_rows(spark, docs):
    twice = docs.union(docs.withColumn("text", F.concat(F.col("text"), F.lit(" again"))))
    a, b = li.train(twice), li.train(twice.repartition(5).sortWithinPartitions("n_chars"))
    assert (a["logits"] == b["logits"]).all() and a["temperature"] == b["temperature"]


def test_no_label_of_a_held_out_row_is_learnt(docs):
    twisted = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    assert sorted(map(tuple, li.language_id(docs).collect())) == sorted(map(tuple, li.language_id(twisted).collect()))


def test_odd_rows(odd_extra, empty):
    got = li.language_id(odd_extra).collect()
    assert len(got) == 15
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1, 2, 3, 10))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert by[6]["lang_pred"] == by[7]["lang_pred"] and by[6]["score"] == by[7]["score"]
    assert li.language_id(empty).count() == 0 and li.keep_identified(empty).count() == 0
    kept = li.keep_identified(odd_extra)
    assert kept.columns == odd_extra.columns and 1 not in [r["doc_id"] for r in kept.collect()]


def test_clean_documents_stay(docs):
    assert li.keep_identified(docs).count() >= 0.97 * docs.count()
