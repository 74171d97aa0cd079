import random

import pytest

from lamina.llm import token_counts as tc
from lamina.llm.encoding import tokenizer, vocabulary_path

from .conftest import odd_rows, words

PATH = vocabulary_path()


def library(text):
    return len(tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk,overlap", [(300, 8), (1000, 16), (4096, 64)])
def test_chunks_count_as_the_whole(chunk, overlap):
    rng = random.Random(1)
    texts = ["a" * 7000, " " * 5000 + "x", "x<|endoftext|>" * 500, "\n\n a" * 900, "é" * 4000, words(rng, 3000), "12 3456789" * 500,
             "".join(rng.choices([" ", "\n", "\t", "a", "b", "'s", "<|endoftext|>", "<|", "é", "1", "　"], k=6000))]
    for t in texts:
        assert tc.count_huge(PATH, t, chunk, overlap) == library(t)


def test_table(docs):
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    for chunk in (tc.CHUNK, 500):
        for r in tc.token_counts(docs, chunk=chunk).collect():
            t = want[r["doc_id"]]
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), library(t), library(t) > 1024)


def test_odd_rows(odd_extra, empty):
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tc.token_counts(odd_extra).collect())
    assert got == sorted((str(d), library(t)) for d, t, *_ in odd_rows())
    assert tc.token_counts(empty).count() == 0
