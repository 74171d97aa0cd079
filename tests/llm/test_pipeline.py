import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lamina.llm import near_dedup as nd

from .conftest import DOC_SCHEMA


def test_each_stage_keeps_the_columns_and_rows_of_its_input(spark, sf_dir, docs):
    at = docs
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, at, sf_dir).cache()
        assert out.columns == docs.columns, name
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert now and now <= ids, name
        at, ids = out, now
    last = cp.STAGES[-1][1](spark, at, sf_dir)
    assert last.count() == at.count()
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_run(spark, sf_dir):
    got = cp.run(spark, sf_dir).collect()
    assert got and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_extra, empty):
    for table in (odd_extra, empty, odd_extra.where("doc_id IS NULL"), odd_extra.where("text IS NULL")):
        for name, stage in cp.STAGES:
            out = stage(spark, table, sf_dir)
            n = out.count()
            if name != "token_output":
                assert out.columns == table.columns, name
            if name not in ("mixing", "token_output"):
                assert n <= table.count(), name
            if name == "token_output":
                assert n == table.count()


def test_what_each_stage_does_to_odd_rows(spark, sf_dir, odd):
    stages = dict(cp.STAGES)
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    every = ids(odd)
    kept = ids(stages["language_id"](spark, odd, sf_dir))
    assert not {"1", "2", "3", "10"} & set(kept)
    # 6, 7, 8 (twice) and 12 say the same; null ids are linked with nothing.
    assert ids(stages["near_dedup"](spark, odd, sf_dir)) == sorted(x for x in every if x not in {"7", "8", "12"})
    assert ids(stages["decontaminate"](spark, odd, sf_dir)) == every


def test_the_stages_before_the_mix_equal_brute_force(spark, sf_dir, docs):
    from .test_decontaminate import brute

    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"] for r in cp.identify_language(spark, docs, sf_dir).collect()}
    sets = {}
    for i in after:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), rows[i]["text"]))
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in after}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(after)
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= cp.NEAR_PERCENT * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    one = {i for i in after if find(i) == i}
    at = cp.drop_near_duplicates(spark, docs.where(F.col("doc_id").isin(sorted(after))), sf_dir)
    assert {r["doc_id"] for r in at.collect()} == one
    want = {int(w[0]) for w in brute([tuple(rows[i]) for i in one], bench) if not w[5]}
    assert {r["doc_id"] for r in cp.drop_contaminated(spark, docs.where(F.col("doc_id").isin(sorted(one))), sf_dir).collect()} == want


def test_near_copies_from_four_fifths_up_are_dropped(spark, sf_dir):
    rng = random.Random(8)
    rows, sets, gone = [], [], set()
    for g in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        # A changed end of k words leaves 200 - k of 200 + k shingles: 170/230 = 0.74, 178/222 = 0.802, 183/217 = 0.843.
        for k in (0, 22, 17, 30):
            if k == 0 or k == (22, 17, 30)[g % 3]:
                ws = base[: 204 - k] + [f"e{g}x{i}" for i in range(k)]
                rows.append((len(rows), " ".join(ws), "en", "s", 1))
                sets.append({tuple(ws[i : i + 5]) for i in range(200)})
    for i in range(0, len(rows), 2):
        both = len(sets[i] & sets[i + 1])
        if 100 * both >= 80 * (400 - both):
            gone.add(i + 1)
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    left = {r["doc_id"] for r in cp.drop_near_duplicates(spark, df, sf_dir).collect()}
    assert left == {r[0] for r in rows} - gone and 20 < len(gone) < 40
    assert nd.near_dedup(df).where("NOT kept").isEmpty()  # op3 links from 0.85 up


def test_plans_of_similarities():
    assert nd.plan(85) == (85, nd.CHUNKS) and nd.plan(85).distance == nd.DISTANCE and nd.plan(85).width == nd.WIDTH
    assert (nd.plan(80).chunks, nd.plan(80).width, nd.plan(80).distance) == (15, 4, 29)
