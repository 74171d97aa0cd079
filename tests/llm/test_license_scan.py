import random
import re

from lamina.llm import license_scan as ls

from .conftest import DOC_SCHEMA, odd_rows

PHRASES = {"mit": b"under the mit license", "apache-2": b"apache license version 2", "cc-by-nc": b"cc by nc"}


def expected(rows):
    out = []
    for doc, text, *_ in rows:
        ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        at = [(i, k) for k, p in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        out.append((str(doc), len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at}))))
    return sorted(out, key=str)


def result(df):
    cols = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    return sorted(((str(r["doc_id"]), *(r[c] for c in cols)) for r in ls.license_scan(df).collect()), key=str)


def test_table_matches_brute_force(docs):
    got = result(docs)
    assert got == expected([tuple(r) for r in docs.collect()])
    assert any(r[2] for r in got)


def test_places_passages_and_scores(spark):
    mit = next(t for t in ls.TEMPLATES if t.label == "mit" and t.key).text
    texts = ["Under the MIT license, under the mit License", "cc-by-nc cc by cc by nc", "Apache License, Version 2.0", f"x {mit} y",
             mit.replace("software", "program", 1), mit.replace("hereby", "thereby"), "under the the mit license", "license mit the under"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    assert result(df) == expected(rows)
    by = {r["doc_id"]: r for r in ls.license_scan(df).collect()}
    assert by[3]["labels"] == "mit" and by[3]["score"] == 1 and by[3]["n_base"] == 0
    assert by[4]["labels"] == "mit" and 0.8 <= by[4]["score"] < 1
    assert by[5]["labels"] == "" and by[7]["score"] == 0


def test_a_passage_without_its_rarest_word(spark):
    passages = [t for t in ls.TEMPLATES if t.key]
    rows = []
    for t in passages:
        ws = t.text.split()
        keys = [k.split() for k in t.key.split("|")]
        fixed = {i + j for k in keys for i in range(len(ws)) if ws[i : i + len(k)] == k for j in range(len(k))}
        for i in sorted(set(range(len(ws))) - fixed):
            rows.append((len(rows), " ".join(["before", *ws[:i], "mispelt", *ws[i + 1 :], "after"]), t.label, "s", 1))
    got = {r["doc_id"]: r["labels"].split(",") for r in ls.license_scan(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert all(label in got[i] for i, _, label, *_ in rows)
    # Alone, every edited word is one that no document holds.
    for i in range(0, len(rows), 9):
        alone = ls.license_scan(spark.createDataFrame(rows[i : i + 1], DOC_SCHEMA)).first()
        assert alone["labels"].split(",") == got[i]


def test_places_equal_all_alignments():
    rng = random.Random(1)
    index = ls.Index()
    for n in range(300):
        ws = ["x"]
        for t in rng.sample(ls.TEMPLATES, 2):
            ws += [rng.choice(["x", "the", "license"]) if rng.random() < 0.12 else w for w in t.text.split()]
        index.rank({w: rng.randint(0, 9) for w in index.vocab.values()})
        ids = index.ids(" ".join(ws[n % 4 :]).encode())
        assert sorted(index.places(ids)) == sorted(alignments(index, ids.tolist()))


def alignments(index, ids):
    for t, (template, want) in enumerate(zip(index.templates, index.words, strict=True)):
        n = len(want)
        for s in range(1 - n, len(ids)):
            agree = sum(0 <= s + i < len(ids) and ids[s + i] == w for i, w in enumerate(want.tolist()))
            part = ids[max(0, s) : s + n]
            keys = [[index.vocab[w] for w in k.encode().split()] for k in template.key.split("|")]
            holds = all(any(part[i : i + len(k)] == k for i in range(len(part))) for k in keys)
            if agree == n if not template.key else agree >= ls.MATCH * n and holds:
                yield t, max(0, s), agree / n


def test_gpl_versions_are_told_apart(spark):
    headers = {t.label: t.text for t in ls.TEMPLATES if t.label.startswith("gpl") and t.key}
    short = "This work is licensed under the GNU General Public License, version {}."
    want = [(headers["gpl-3"], "gpl-3"), (headers["gpl-2"], "gpl-2"), (short.format(3), "gpl-3"), (short.format(2), "gpl-2"), (short.format(4), ""),
            (headers["gpl-3"].replace("version 3", "version 4"), ""), (headers["gpl-2"].replace("modify", "change"), "gpl-2"),
            (headers["gpl-3"].replace("general", "lesser"), ""), (short.format(3).replace("General", "Lesser General"), "lgpl-3")]
    got = {r["doc_id"]: r["labels"] for r in ls.license_scan(spark.createDataFrame([(i, t, "en", "s", 1) for i, (t, _) in enumerate(want)], DOC_SCHEMA)).collect()}
    assert [got[i] for i in range(len(want))] == [x for _, x in want]


def test_notices_tags_and_versions(spark):
    want = [
        ("Released under the MIT License.", "mit"), ("BSD 3-Clause License", "bsd"), ("GNU Lesser General Public License version 2.1", "lgpl-2.1"), ("// SPDX-License-Identifier: MPL-2.0", "mpl-2"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
        ("GPL-3.0-or-later", "gpl-3"), ("spdx-license-identifier: apache-2.0 or so", "apache-2"), ("SPDX-License-Identifier: BSL-1.0", "bsl-1"), ("Boost Software License, Version 1.0", "bsl-1"), ("licence of nothing, version 2.1", ""), ("SPDX-License-Identifier: none", ""),
        ("the gnu affero general public license version 3", "agpl-3"), ("CC-BY-SA", "cc-by-sa"), ("GPL-2.0-only", "gpl-2"), ("Eclipse Public License - v 2.0", "epl-2"), ("mit", ""), ("the license of MIT", "")]
    got = {r["doc_id"]: r["labels"] for r in ls.license_scan(spark.createDataFrame([(i, t, "en", "s", 1) for i, (t, _) in enumerate(want)], DOC_SCHEMA)).collect()}
    assert [got[i] for i in range(len(want))] == [x for _, x in want]
    assert len(ls.TEMPLATES) >= 60 and len({t.label for t in ls.TEMPLATES}) >= 30


def test_work_follows_the_hits():
    index = ls.Index()
    ids = index.ids(b"a text about the use of words and of the license in which nothing of this is granted or permitted by any person")
    index.rank({w: 10**6 for w in set(ids.tolist())})  # common words of other texts are not posted
    places = sum(int((words == w).sum()) for words in index.words for w in ids.tolist() if w)
    assert sum(len(starts) for _, starts in index.proposed(ids)) * 3 < places


def test_odd_rows(odd_extra, empty):
    assert result(odd_extra) == expected(odd_rows())
    assert ls.license_scan(empty).count() == 0
