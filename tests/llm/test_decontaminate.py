import hashlib
import random
import re

from lamina.llm import decontaminate as dc

from .conftest import DOC_SCHEMA, odd_rows


def cut(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(rows, items):
    wins = {}
    for item, text in items:
        ws = cut(text)
        for i in range(max(1, len(ws) - 9) if ws else 0):
            wins.setdefault(tuple(ws[i : i + 10]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for doc, text, *_ in rows:
        ws, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if got := wins.get(tuple(ws[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((str(doc), len(ws), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def result(df, bench, **kw):
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((str(r["doc_id"]), *(r[c] for c in cols)) for r in dc.decontaminate(df, bench, **kw).collect())


def longest_runs(ws, items):
    """Maximal stretches of a window's length or more that a text and an item share, by comparing every pair of places."""
    for item, text in items:
        iw = cut(text)
        need = min(10, len(iw))
        for d in range(-len(iw), len(ws)):
            at = None
            for i in range(max(0, d), min(len(ws), len(iw) + d) + 1):
                same = i < min(len(ws), len(iw) + d) and ws[i] == iw[i - d]
                if same and at is None:
                    at = i
                if not same and at is not None:
                    if i - at >= need:
                        yield item, at, at - d, i - at
                    at = None


def test_matches_brute_force(spark, sf_dir, docs):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert result(docs, bench) == want
    assert result(docs, bench, block_words=100) == want
    for words in (dc.BLOCK_WORDS, 100):
        clean = sorted(r["doc_id"] for r in dc.keep_clean(docs, bench, words).collect())
        assert clean == sorted(int(w[0]) for w in want if not w[5])


def test_short_items_and_odd_rows(spark, odd_extra, empty):
    items = [(1, "One"), (2, None), (3, "..."), (None, "one"), (4, "ONE two, three"), (5, "one"), (6, "x y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = [i for i in items if i[0] is not None]
    assert result(odd_extra, bench) == brute(odd_rows(), kept)
    assert result(odd_extra, bench, block_words=2) == brute(odd_rows(), kept)
    assert result(odd_extra, bench, block_words=2, probe_windows=2) == brute(odd_rows(), kept)
    for words in (2, 100):
        left = dc.keep_clean(odd_extra, bench, words)
        assert left.columns == odd_extra.columns
        assert sorted(str(r["doc_id"]) for r in left.collect()) == [w[0] for w in brute(odd_rows(), kept) if not w[5]]
        assert dc.keep_clean(empty, bench, words).count() == 0
    assert dc.decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in dc.decontaminate(odd_extra, bench.limit(0)).collect())


def test_locations_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([2, 14, 25, 60])))) for i in range(12)]
    rows = []
    for d in range(25):
        ws = rng.choices(vocab, k=40)
        for _ in range(2):
            _, text = rng.choice(items)
            part = text.split()
            a = rng.randrange(max(1, len(part) - 12))
            ws[rng.randrange(40) :] = part[a : a + rng.randint(8, 40)] + rng.choices(vocab, k=10)
        rows.append((d, " ".join(ws), None, None, None))
    df, bench = spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, *x) for d, text, *_ in rows for x in longest_runs(cut(text), items))
    assert len(want) > 20
    for words in (dc.BLOCK_WORDS, 50):
        assert sorted(map(tuple, dc.locations(df, bench, words).collect())) == want


def test_an_item_of_millions_of_distinct_words():
    words = [b"w%d" % i for i in range(2_200_000)]
    block = dc.Block([(1, words[:20]), (2, words)])
    got = dc.search_shard([b" ".join(words[1_000_000:1_000_020]), b" ".join(words[5:9])], block)
    assert got["items"] == [[2], []] and got["longest"] == [20, 0]


def test_longest_match():
    item = [f"w{i}".encode() for i in range(40)]
    block = dc.Block([(7, item)])
    text = b"zz " + b" ".join(item[5:30]) + b" zz " + b" ".join(item[:12])
    got = dc.search_shard([text, None], block)
    assert got["longest"] == [25, 0]
    assert got["hits"][0] == [{"s": 1, "e": 26}, {"s": 27, "e": 39}]
    assert got["items"] == [[7], []]
