"""License scans with a positional rare-token index.

Templates are phrases, tags and passages of well-known licences. Document frequencies of their words are counted over the
whole corpus first; they order each template's positions by IDF. Where need of a template's n words must agree, an accepted
alignment disagrees at n - need places at most, so it agrees at one of any n - need + 1 positions (pigeonhole): the rarest so many are
posted, as word -> (template, position). A file looks up its own words: those that the postings hold are its highest-IDF licence words,
and each propose the alignments of their postings. A proposed alignment is verified by the words at the same relative positions; their share that agrees is
its score. So a file's work follows what its rare words hit and not the number of templates, and no accepted alignment is left out whatever
the frequencies are. A phrase or tag needs all of its words; a passage needs MATCH of them and, inside the aligned
stretch, its mandatory key phrases word for word; the version is part of them where versions share their wording.

Defined cases: null, empty and wordless texts have n_words 0 and no labels; overlapping places all count;
equal texts and repeated rows get equal values; other columns are not read; an empty table gives an empty
result."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, arrow_map, as_bytes

MATCH = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str = ""  # mandatory phrases of a passage, | between them
    base: bool = False


# Base phrases, then public licences' wording.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
PASSAGES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license|version 3 of the license"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license|version 2 of the license"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", "gnu lesser general public license|version 3 of the license"),
    Template("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "gnu lesser general public license|version 2 1 of the license"),
    Template("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license|version 3 of the license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "with or without fee"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike", "creative commons attribution sharealike"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy"),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "as long as the name is changed"),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide", "dedicated the work to the public domain"),
)
#: Label, names under which notices speak of the licence, and its identifiers in tags.
NAMED = (
    ("mit", ("the mit license", "mit license"), ("mit",)), ("apache-2", ("apache 2 0 license", "apache license 2 0"), ("apache 2 0",)), ("apache-1.1", ("apache software license version 1 1",), ("apache 1 1",)),
    ("bsd", ("bsd 3 clause license", "bsd 2 clause license", "3 clause bsd license", "2 clause bsd license", "bsd license"), ("bsd 3 clause", "bsd 2 clause", "0bsd")),
    ("gpl-3", ("gnu gpl v3", "gplv3", "gnu general public license v3"), ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")), ("gpl-2", ("gnu gpl v2", "gplv2", "gnu general public license v2"), ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later")),
    ("lgpl-3", ("gnu lesser general public license version 3", "lgplv3"), ("lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later")), ("lgpl-2.1", ("gnu lesser general public license version 2 1", "lgplv2 1"), ("lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later")),
    ("agpl-3", ("gnu affero general public license version 3", "agplv3"), ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")), ("mpl-2", ("mozilla public license version 2 0", "mozilla public license 2 0"), ("mpl 2 0",)), ("mpl-1.1", ("mozilla public license version 1 1",), ("mpl 1 1",)),
    ("epl-2", ("eclipse public license version 2 0", "eclipse public license v 2 0"), ("epl 2 0",)), ("epl-1", ("eclipse public license version 1 0", "eclipse public license v1 0"), ("epl 1 0",)), ("cddl-1", ("common development and distribution license",), ("cddl 1 0",)),
    ("isc", ("the isc license", "isc license"), ("isc",)), ("zlib", ("zlib license", "zlib libpng license"), ("zlib",)), ("unlicense", ("the unlicense", "unlicense org"), ("unlicense",)), ("wtfpl", ("do what the fuck you want to public license",), ("wtfpl",)),
    ("bsl-1", ("boost software license version 1 0", "boost software license"), ("bsl 1 0",)), ("artistic-2", ("the artistic license 2 0", "artistic license 2 0"), ("artistic 2 0",)), ("ofl-1.1", ("sil open font license",), ("ofl 1 1",)), ("eupl-1.2", ("european union public licence v 1 2", "eupl v1 2"), ("eupl 1 2",)),
    ("ms-pl", ("microsoft public license",), ("ms pl",)), ("postgresql", ("postgresql license",), ("postgresql",)), ("python-2", ("python software foundation license version 2",), ("psf 2 0", "python 2 0")), ("ncsa", ("university of illinois ncsa open source license",), ("ncsa",)),
    ("upl-1", ("universal permissive license",), ("upl 1 0",)), ("osl-3", ("open software license version 3 0",), ("osl 3 0",)), ("cc0-1", ("cc0 1 0 universal", "creative commons zero"), ("cc0 1 0",)), ("cc-by", ("creative commons attribution 4 0 international",), ("cc by 4 0",)),
    ("cc-by-sa", ("creative commons attribution sharealike", "cc by sa"), ("cc by sa 4 0", "cc by sa 3 0")), ("cc-by-nc", ("creative commons attribution noncommercial",), ("cc by nc 4 0",)), ("cc-by-nd", ("creative commons attribution noderivatives", "cc by nd"), ("cc by nd 4 0",)),
)


def named() -> tuple[Template, ...]:
    """A phrase for each name, and a tag for each identifier."""
    out = []
    for label, names, ids in NAMED:
        out += [Template(label, n) for n in names]
        out += [Template(label, f"spdx license identifier {i}") for i in ids]
        out += [Template(label, i) for i in ids if i.endswith(("only", "or later"))]
    return tuple(out)


TEMPLATES = BASE + PASSAGES + named()


class Index:
    """The templates' words, and postings of their rarest positions."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        words = [t.text.encode().split() for t in templates]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted(set(itertools.chain(*words))))}
        self.words = [np.array([self.vocab[w] for w in ws], np.int32) for ws in words]
        self.keys = [[np.array([self.vocab[w] for w in k.split()], np.int32) for k in t.key.encode().split(b"|")] for t in templates]
        self.need = [math.ceil(MATCH * len(w)) if t.key else len(w) for t, w in zip(templates, self.words, strict=True)]
        self.rank({})

    def rank(self, frequency: dict[int, int]) -> Index:
        """Post each template's rarest positions: words in the fewest documents first (the first of equals)."""
        posted = []
        for t, (ids, need) in enumerate(zip(self.words, self.need, strict=True)):
            order = np.argsort([frequency.get(w, 0) for w in ids.tolist()], kind="stable")
            posted += [(int(ids[p]), t, p) for p in order[: len(ids) - need + 1].tolist()]
        posted.sort()
        word, self.template, self.position = (np.array(x, np.int64) for x in zip(*posted, strict=True))
        self.first = np.searchsorted(word, np.arange(len(self.vocab) + 2))
        return self

    def ids(self, text: bytes | None) -> np.ndarray:
        ws = alnum_words(text) if text else []
        return np.fromiter(map(self.vocab.get, ws, itertools.repeat(0)), np.int32, len(ws))

    def proposed(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(template, starts) of the alignments that postings of the file's words give."""
        count = (self.first[1:] - self.first[:-1])[ids]
        at = np.flatnonzero(count * (ids > 0))
        if not len(at):
            return []
        count, entry = count[at], self.first[ids[at]]
        which = np.repeat(entry, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(at, count) - self.position[which]
        shift = int(start.min())
        key = np.unique(self.template[which] * (len(ids) - shift + 1) + start - shift)
        template, start = np.divmod(key, len(ids) - shift + 1)
        edge = np.flatnonzero(np.concatenate([[True], template[1:] != template[:-1]]))
        return [(int(template[a]), start[a:b] + shift) for a, b in zip(edge, [*edge[1:], len(key)], strict=True)]

    def places(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, start, score) of the accepted alignments."""
        out = []
        for t, start in self.proposed(ids):
            want, n = self.words[t], len(self.words[t])
            if self.templates[t].key:
                agree = np.zeros(len(start), np.int32)
                for i, w in enumerate(want.tolist()):
                    p = start + i
                    inside = (p >= 0) & (p < len(ids))
                    agree += inside & (ids[p.clip(0, len(ids) - 1)] == w)
                for s, a in zip(start[agree >= MATCH * n].tolist(), agree[agree >= MATCH * n].tolist(), strict=True):
                    if all(_holds(ids[max(0, s) : s + n], k) for k in self.keys[t]):
                        out.append((t, max(0, s), a / n))
            else:
                start = start[(start >= 0) & (start + n <= len(ids))]
                for i, w in enumerate(want.tolist()):
                    start = start[ids[start + i] == w]
                out += [(t, s, 1.0) for s in start.tolist()]
        return out


def _holds(ids: np.ndarray, phrase: np.ndarray) -> bool:
    n = len(phrase)
    if len(ids) < n:
        return False
    ok = np.ones(len(ids) - n + 1, bool)
    for i, w in enumerate(phrase.tolist()):
        ok &= ids[i : len(ids) - n + 1 + i] == w
    return bool(ok.any())


def frequencies(docs: DataFrame, index: Index) -> dict[int, int]:
    """Documents that hold each of the index's words; each batch gives one row a word at most."""

    def run(batch: pa.RecordBatch) -> dict:
        total = np.zeros(len(index.vocab) + 1, np.int64)
        for text in as_bytes(batch.column("text")):
            total[np.unique(index.ids(text))] += 1
        at = np.flatnonzero(total[1:]) + 1
        return {"word": at, "n": total[at]}

    got = arrow_map(docs.select("text"), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in got.collect()}  # no more rows than the templates have words


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The report for every row of (doc_id, text)."""
    index = Index(templates)
    index.rank(frequencies(docs, index))

    def run(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in as_bytes(batch.column("text")):
            ids = index.ids(text)
            places = index.places(ids) if len(ids) else []
            base = [(t, s) for t, s, _ in places if index.templates[t].base]
            starts = [s for _, s in base]
            name = lambda ts: ",".join(sorted({index.templates[t].label for t in ts}))
            for c, v in zip(out, (len(ids), len(base), min(starts, default=None), max(starts, default=None), name(t for t, _ in base),
                                  name(t for t, _, _ in places), max((x for _, _, x in places), default=0.0)), strict=True):
                out[c].append(v)
        return {"doc_id": batch.column("doc_id")} | out

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
