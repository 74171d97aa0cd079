"""Encoding of whole texts with a byte-level BPE of the tokenizers library, piece by piece.

The library's pre-tokeniser starts a new pre-token at a space that does not lie inside a run of white
space, and never merges across pre-tokens. So a text without a space between two white-space
characters is cut before its spaces, and each distinct piece is encoded by the library once and
remembered (the memory is emptied when full). Any other text, and one that holds an added token's
string, goes to the library as a whole. The ids equal the library's for the whole text."""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from .common import held

_RUN = re.compile(r"\s \s")
#: Pieces and their characters that a worker remembers.
_MEMO = 1_400_000
_MEMO_CHARS = 32_000_000


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def added_tokens(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id's token; the byte-level alphabet has one character for each byte."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


class _Index(dict):
    """Piece to number; a new piece gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        i = self[piece] = len(self)
        self.waiting.append(piece)
        return i


class Encoder:
    """Encodes many texts at once. A piece stands without its leading space; a text's first piece, which has
    none, is told apart by a NUL before it where it isn't empty."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.chars = 0
        self.start = np.zeros(1 << 14, np.int32)
        self.count = np.zeros(1 << 14, np.int32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(tokenizer(self.path).encode(text, add_special_tokens=False).ids, np.uint32)

    def _store(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.used += len(ids)

    def _learn(self) -> None:
        """Encode the waiting pieces as one text; the lengths of its tokens tell where each piece ends."""
        pieces, self.index.waiting = self.index.waiting, []
        self.chars += sum(map(len, pieces))
        base = len(self.index) - len(pieces)
        while len(self.index) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        odd = [i for i, p in enumerate(pieces) if not p or p[0] == "\0" or p[0].isspace()]
        for i in odd:
            p = pieces[i]
            ids = self._whole(p[1:] if p[:1] == "\0" else " " + p)
            self._store(np.array([base + i]), ids, np.array([len(ids)]))
        drop = set(odd)
        plain = [i for i in range(len(pieces)) if i not in drop] if odd else range(len(pieces))
        if len(plain):
            joined = " " + " ".join(pieces[i] for i in plain)
            ids = np.array(tokenizer(self.path).encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
            ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
            cut = np.searchsorted(np.cumsum(token_bytes(self.path)[ids]), ends) + 1
            self._store(base + np.asarray(plain), ids, np.diff(cut, prepend=0))

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Piece numbers of all texts, how many each text has, and the ids of texts that went to the library whole."""
        if len(self.index) > _MEMO or self.chars > _MEMO_CHARS:
            self.clear()
        pieces: list[str] = []
        many, whole = [], {}
        added = added_tokens(self.path)
        for i, text in enumerate(texts):
            before = len(pieces)
            if text:
                if "\0" in text or _RUN.search(text) or any(t in text for t in added):
                    whole[i] = self._whole(text)
                else:
                    cut = text.split(" ")
                    if cut[0]:
                        cut[0] = "\0" + cut[0]
                    else:
                        del cut[0]
                    pieces += cut
            many.append(len(pieces) - before)
        numbers = np.fromiter(map(self.index.__getitem__, pieces), np.int32, len(pieces))
        if self.index.waiting:
            self._learn()
        return numbers, np.array(many, np.int64), whole

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, many, whole = self._numbers(texts)
        total = np.concatenate([[0], np.cumsum(self.count[numbers])])
        ends = np.cumsum(many)
        out = total[ends] - total[ends - many]
        for i, ids in whole.items():
            out[i] = len(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text as the library gives them."""
        numbers, many, whole = self._numbers(texts)
        count = self.count[numbers]
        stop = np.cumsum(count)
        shift = (self.start[numbers] - stop + count).astype(np.int32)  # a batch has far fewer than 2**31 ids
        ids = self.flat[np.repeat(shift, count) + np.arange(stop[-1] if len(stop) else 0, dtype=np.int32)]
        edge = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(many)])]
        out = [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        for i, x in whole.items():
            out[i] = x
        return out


def encoder(path: str) -> Encoder:
    mine = held("encoding")
    if path not in mine:
        mine[path] = Encoder(path)
    return mine[path]
