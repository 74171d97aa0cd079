import random
import re
from collections import Counter, defaultdict

from lamina.llm import divergence as dv

from .conftest import DOC_SCHEMA, odd_rows, words


def brute(rows):
    """Both parts by the definition, over the dense table."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        mine = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        docs[lang].update(set(mine))
        count[lang, source].update(mine)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        mine = sorted(s for a, s in groups if a == lang)
        total = Counter()
        for s in mine:
            total.update(count[lang, s])

        def p(c, kept=kept):
            size = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (size + len(kept)) for t in kept}

        every, q = {s: p(count[lang, s]) for s in mine}, p(total)
        for s in mine:
            pairs = [(o, sum((every[s][t] - every[o][t]) ** 2 // every[o][t] for t in kept)) for o in mine if o != s]
            terms = [(t.decode(), (every[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] and every[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", terms)):
                values.sort(key=lambda v: (-v[1], v[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(values) if part == "pair" or k < 200]
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in dv.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect())


def test_matches_the_definition_on_the_table(docs):
    assert result(docs) == brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])


def test_odd_rows(odd_extra, empty):
    assert result(odd_extra) == brute(odd_rows())
    assert result(empty) == []


def test_sources_without_terms_and_a_hot_one(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(0, 30)), "en", f"s{i % 5}" if i % 3 else "hot", 1) for i in range(200)]
    rows += [(300, "", "en", "bare", 1), (301, None, "en", "s1", 1), (302, "lonely", "xx", "a", 1), (303, "words", "xx", "b", 1), (304, "Été É é été é été", "fr", "a", 1)] + [(i, "été É", "fr", "b", 1) for i in range(4)]
    monkeypatch.setattr(dv, "HELD", 20)
    assert result(spark.createDataFrame(rows, DOC_SCHEMA)) == brute(rows)
