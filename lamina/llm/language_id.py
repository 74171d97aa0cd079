"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is lower-cased and cut into runs of letters; its features are the byte n-grams of each run
with its two ends marked, hashed into BUCKETS. A document's vector is the mean of its features'
embeddings, its class probabilities a softmax of a linear map of that vector. At prediction the two
linear maps are one table of bucket logits, so the work for a document is a histogram and a product.

Training uses a bounded sample of labelled rows: about PER_LANG whole texts of each language, picked
by a hash of doc_id (a documented bound of the fit alone). Every row is predicted.

Rejection is calibrated on a tenth of the sample that training does not see: the temperature that
minimises its log loss, and a score threshold that at most REJECT_RATE of its correct predictions
fall under, never above 0.5, so clean documents stay.

Defined cases: a null text or one without a letter gets lang_pred 'und', score 0.0 and is rejected;
a null doc_id counts as not held out and never trains; without any labelled row all get 'und';
repeated rows and equal texts get equal values; other columns are not read."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, slices

BUCKETS = 8192
DIM = 16
GRAMS = (2, 3, 4)
PER_LANG = 400
EPOCHS = 40
REJECT_RATE = 0.001
SEED = 7

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def features(text: str | None) -> np.ndarray | None:
    """Histogram of hashed subword n-grams over the whole text; None without letters."""
    if text is None or not _LETTER.search(text):
        return None
    raw = np.frombuffer((" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8)
    at = raw.astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for n in GRAMS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, 0x9E37 + n, np.uint32)
        for i in range(n):
            h = (h ^ at[i : len(raw) - n + 1 + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        inner = np.zeros(len(h), bool)
        for i in range(1, n - 1):
            inner |= raw[i : len(raw) - n + 1 + i] == 32
        total += np.bincount((h % BUCKETS)[~inner], minlength=BUCKETS)
    return total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Sparse:
    """Rows of mean features, kept as (bucket, share) lists; take() gives some of them as a dense block."""

    def __init__(self, idx: list, val: list):
        self.size = np.array([len(i) for i in idx], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.idx = np.concatenate([np.asarray(i, np.int16) for i in idx])
        self.val = np.concatenate([np.asarray(v, np.float32) for v in val])

    def take(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows.tolist()):
            at = slice(self.start[r], self.start[r] + self.size[r])
            out[k, self.idx[at]] = self.val[at]
        return out

    def logits(self, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
        return np.concatenate([self.take(rows[lo : lo + 256]) @ table for lo in range(0, len(rows), 256)])


def fit(x: Sparse, y: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Bucket logits (BUCKETS x k) of the embedding model after SGD on the given rows of x (mean features)."""
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, k)).astype(np.float32)
    weight = (len(rows) / (k * np.maximum(np.bincount(y[rows], minlength=k), 1))).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = 20.0 * (1 - epoch / EPOCHS)
        order = rows[rng.permutation(len(rows))]
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            part, lab = x.take(pick), y[pick]
            hid = part @ emb
            g = _softmax(hid @ out)
            g[np.arange(len(lab)), lab] -= 1
            g *= weight[lab][:, None] / len(lab)
            step_out, step_hid = hid.T @ g, g @ out.T
            out -= rate * 0.1 * step_out
            emb -= rate * (part.T @ step_hid)
    return emb @ out


def train(docs: DataFrame, per_lang: int = PER_LANG) -> dict:
    """Model from (doc_id, text, lang) rows with crc32(doc_id) mod 4 other than 2."""
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("h")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    )
    counts = {r[0]: r[1] for r in docs.select("doc_id", "lang", F.col("text").isNotNull().alias("t")).where(
        "t AND lang IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "logits": None, "temperature": 1.0, "threshold": 0.0}
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, per_lang / counts[lang])).otherwise(share)
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1_000_003)) / 1_000_003
    at = {lang: i for i, lang in enumerate(langs)}

    def hists(batch: pa.RecordBatch) -> dict:
        keep_id, keep_lang, keep_h, idx, val = [], [], [], [], []
        for doc, text, lang, h in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "h")), strict=True):
            if (f := features(text)) is not None:
                nz = np.flatnonzero(f)
                keep_id.append(doc)
                keep_lang.append(at[lang])
                keep_h.append(h)
                idx.append(nz.astype(np.int16))
                val.append((f[nz] / f.sum()).astype(np.float32))
        return {"doc_id": keep_id, "y": keep_lang, "h": keep_h, "idx": idx, "val": val}

    got = arrow_map(rows.where(dice < share), hists, "doc_id long, y int, h long, idx array<short>, val array<float>").toPandas()
    got = got.sort_values(["doc_id", "y", "h"], kind="stable")
    y = got["y"].to_numpy()
    if not len(y):
        return {"langs": [], "logits": None, "temperature": 1.0, "threshold": 0.0}
    x = Sparse(list(got["idx"]), list(got["val"]))
    held = np.arange(len(y)) % 10 == 9
    del got
    logits = fit(x, y, np.flatnonzero(~held), len(langs))
    temperature, threshold = 1.0, 0.0
    if held.any():
        z = x.logits(np.flatnonzero(held), logits)
        best = np.inf
        for t in np.geomspace(0.25, 8, 41):
            p = _softmax(z / t)[np.arange(len(z)), y[held]]
            loss = -np.log(np.maximum(p, 1e-12)).mean()
            if loss < best:
                best, temperature = loss, float(t)
        p = _softmax(z / temperature)
        right = p.argmax(axis=1) == y[held]
        if right.any():
            threshold = min(0.5, float(np.quantile(p.max(axis=1)[right], REJECT_RATE)))
    return {"langs": langs, "logits": logits.astype(np.float32), "temperature": temperature, "threshold": threshold}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of (doc_id, text)."""
    langs, temperature, threshold = model["langs"], model["temperature"], model["threshold"]
    table = docs.sparkSession.sparkContext.broadcast(model["logits"])  # BUCKETS x languages floats

    def label(batch: pa.RecordBatch) -> dict:
        pred, score = [], []
        for text in batch.column("text").to_pylist():
            f = features(text) if langs else None
            if f is None:
                pred.append("und")
                score.append(0.0)
                continue
            p = _softmax(((f.astype(np.float32) @ table.value) / max(1, f.sum()) / temperature).astype(np.float64))
            pred.append(langs[int(p.argmax())])
            score.append(float(min(1.0, p.max())))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pred, "score": score,
                "rejected": [a == "und" or s < threshold for a, s in zip(pred, score, strict=True)]}

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", held), label,
                     "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the labelled part of docs and predict all of docs."""
    return predict(docs, train(docs))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns, whose language is not rejected; in one pass beside the training."""
    model = train(docs)
    langs, temperature, threshold = model["langs"], model["temperature"], model["threshold"]
    table = docs.sparkSession.sparkContext.broadcast(model["logits"])

    def run(batches):
        for batch in slices(batches):
            keep = []
            for text in batch.column("text").to_pylist():
                f = features(text) if langs else None
                if f is None:
                    keep.append(False)
                    continue
                p = _softmax(((f.astype(np.float32) @ table.value) / max(1, f.sum()) / temperature).astype(np.float64))
                keep.append(bool(p.max() >= threshold))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
