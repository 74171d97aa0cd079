"""Token counts with overlap resynchronisation for huge documents.

A document of more than CHUNK characters is encoded in chunks that overlap, each with the library's
offsets. Two neighbouring chunks are spliced at a stable common boundary: a position inside their
overlap at which both start a pre-token, far enough from both edges. The pre-tokeniser and the search
for added tokens run left to right and look one character ahead at most, so from a position where both
chunks start a pre-token they go on alike; hence the counts before and after it add up to the count of
the whole. Where an overlap has no such position it is widened (doubled, the next chunk starting
earlier), up to a single chunk that reaches from the left one's start. Other documents are counted as a whole.

Defined cases: null and empty texts count 0 bytes and 0 tokens; white space and control characters count as
the library has them; equal texts and repeated rows get equal values; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map
from .encoding import added_tokens, encoder, tokenizer, vocabulary_path

CHUNK = 32_768
OVERLAP = 512
LIMIT = 1024
BATCH = 512


def _pretokens(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens in text, and the number of tokens before each of them."""
    e = tokenizer(path).encode(text, add_special_tokens=False)
    if not e.ids:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.array([a for a, _ in e.offsets], np.int64)
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    # A pre-token starts where the word changes; an added token stands alone and has no word.
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (word[1:] < 0)])
    return at[new], np.flatnonzero(new)


def count_huge(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text by chunks; equals the count of the whole."""
    margin = 1 + max([0, *(len(t) for t in added_tokens(path))])
    n, done, total = len(text), 0, 0
    while True:  # text[done:] is still to count, and done starts a pre-token
        end = min(n, done + chunk)
        if end == n:
            return total + len(tokenizer(path).encode(text[done:], add_special_tokens=False).ids)
        starts, before = _pretokens(path, text[done:end])
        starts = starts + done
        reach = overlap
        while True:
            left = max(done, end - reach)
            other, _ = _pretokens(path, text[left : min(n, end + reach)])
            common = np.intersect1d(starts, other + left)
            stable = common[(common >= left + (margin if left > done else 1)) & (common <= end - margin) & (common > done)]
            if len(stable):
                cut = int(stable[-1])
                total += int(before[np.searchsorted(starts, cut)])
                done = cut
                break
            if left == done:  # no boundary in the whole chunk: make the chunk itself longer
                chunk *= 2
                break
            reach *= 2


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of (doc_id, text)."""
    path = vocabulary or vocabulary_path()

    def run(batch: pa.RecordBatch) -> dict:
        enc, out = encoder(path), []
        for at in range(0, batch.num_rows, BATCH):
            texts = batch.column("text").slice(at, BATCH).to_pylist()
            huge = {i for i, t in enumerate(texts) if t and len(t) > chunk}
            counts = enc.counts([None if i in huge else t for i, t in enumerate(texts)]).tolist()
            for i in huge:
                counts[i] = count_huge(path, texts[i], chunk)
            out += counts
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": out, "over_limit": [n > limit for n in out]}

    base = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return arrow_map(base, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
