"""Divergence of each source from its language's other sources, by inclusion and exclusion over supports.

The sum over all kept terms of f(p, q) for two sources splits by which of them holds a term. Were each term in neither,
the sum would be a constant times the number of terms. The terms that one source holds are then priced as if the other
held none of them: that needs only how many of its terms have each count, a histogram a source. Last, terms that both hold
are put right by joining postings on the term. So the dense table of sources by terms is never made: work follows the
postings, the histograms and the pairs of sources that share a term.

Texts are cut in tasks, which send one row a (lang, source, term) and flush of at most HELD terms: a frequent term or a large source is
pre-aggregated before the shuffle. Both shuffles of postings are by term. The 200 terms of a group are taken by rank, which Spark cuts before it
shuffles.

Sums fit 64 bits whatever the data's size: p is 1 + floor(10^9 (count + 1) / (N + V)), so the sum of (p - 1)^2 over terms is at
most 10^18; f(p, q) is at most (p - 1)^2 where p > q and at most q elsewhere.

Defined cases: null text, lang or source is ''; a row is a document, so rows that repeat a doc_id count each; a group
without kept terms takes part with counts of 0; where a language keeps no term all values of its pairs are 0; an empty table
gives an empty result; other columns are not read."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, broadcast_if_small, discard, slices, stored

#: Documents of a language that must hold a term.
LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: (lang, source, term) counts that a task holds before it sends them.
HELD = 200_000
#: A-Z to a-z; every ASCII byte that is no letter becomes a space.
TERM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_ROWS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: partial counts; a null term marks a group that occurs."""

    def rows(groups: dict) -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (a, b), (count, held) in groups.items():
            lang += [a] * (len(count) + 1)
            source += [b] * (len(count) + 1)
            term += [None, *count]
            n += [0, *count.values()]
            docs += [0, *map(held.__getitem__, count)]
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_ROWS)

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in slices(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), as_bytes(batch.column("text")), strict=True):
                count, held = groups.setdefault((lang, source), (Counter(), Counter()))
                mine = Counter(text.translate(TERM_TABLE).split())
                count.update(mine)
                held.update(mine.keys())
            if sum(len(c) for c, _ in groups.values()) > HELD:
                yield rows(groups)
                groups = {}
        if groups:
            yield rows(groups)

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n, total, terms):
    """p of a count: 1 + floor(SCALE * (n + 1) / (total + terms)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1)
    return F.call_function("div", top, wide(total + terms)).cast("long") + 1


def price(p, q):
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def postings(rows: DataFrame) -> DataFrame:
    """lang, term, source, n, total (the language's occurrences), head (one row a term): kept terms only."""
    by_term = Window.partitionBy("lang", "term")
    # One shuffle by term serves the sums and both windows.
    sums = rows.where("term IS NOT NULL").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = sums.withColumns({"total": F.sum("n").over(by_term), "docs": F.sum("docs").over(by_term), "first": F.min("source").over(by_term)})
    return seen.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "source", "n", "total", (F.col("first") == F.col("source")).alias("head"))


def groups(rows: DataFrame, post: DataFrame) -> DataFrame:
    """A row a group: lang, source, size (its occurrences), terms and lang_size of its language, p0 (p of a count of 0)."""
    each = rows.where("term IS NULL").groupBy("lang", "source").agg(F.count("*").alias("rows"))
    size = post.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("head").cast("long")).alias("heads"))
    both = each.join(size, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("heads", F.lit(0)).alias("heads"))
    lang = both.groupBy("lang").agg(F.sum("heads").alias("terms"), F.sum("size").alias("lang_size"))
    p0 = F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"), F.col("terms")))
    return both.join(lang, "lang").select("lang", "source", "size", "terms", "lang_size", p0.alias("p0"))


def pair_values(priced: DataFrame, stats: DataFrame) -> DataFrame:
    """lang, source, item, value: the sum of f over all kept terms, for each source against each other one of its language."""
    side = lambda x: stats.select("lang", F.col("source").alias(x), F.col("p0").alias(f"p0_{x}"), F.col("terms").alias(f"terms_{x}"))
    p, q, p0, q0 = F.col("p"), F.col("q"), F.col("p0_a"), F.col("p0_b")
    every = side("a").join(side("b"), "lang").where("a <> b")
    both_zero = every.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.coalesce(F.col("terms_a") * price(p0, q0), F.lit(0)).alias("value"))
    # A histogram row of source a, held against b once as p and once as q.
    hist = priced.groupBy("lang", F.col("source").alias("a"), "p", "p0").agg(F.count("*").alias("k")).withColumnRenamed("p0", "p0_a")
    one = hist.join(side("b"), "lang").where("a <> b").groupBy("lang", "a", "b").agg(
        F.sum(F.col("k") * (price(p, q0) - price(p0, q0))).alias("ahead"), F.sum(F.col("k") * (price(q0, p) - price(q0, p0))).alias("back"))
    end = lambda x, t: t.select("lang", "term", F.col("source").alias(x), F.col("p").alias("p" if x == "a" else "q"), F.col("p0").alias(f"p0_{x}"))
    over = lambda x, y, x0, y0: F.sum(price(x, y) - price(x, y0) - price(x0, y) + price(x0, y0))
    two = end("a", priced).join(end("b", priced), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(
        over(p, q, p0, q0).alias("ahead"), over(q, p, q0, p0).alias("back"))
    turned = one.unionByName(two).select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ahead").alias("value")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value")))).alias("v")).select("lang", "v.*")
    return both_zero.unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def ranked(values: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    rows = stored(term_counts(docs), "term-counts")
    post = stored(postings(rows), "postings")
    stats = stored(groups(rows, post), "groups")
    small = broadcast_if_small(stats)
    p = share(F.col("n"), F.col("size"), F.col("terms"))
    q = share(F.col("total"), F.col("lang_size"), F.col("terms"))
    priced = stored(post.join(small, ["lang", "source"]).select("lang", "term", "source", p.alias("p"), q.alias("q"), "p0"), "priced")
    discard(rows, post)
    pairs = ranked(pair_values(priced.drop("q"), small), "pair")
    terms = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    return pairs.unionByName(ranked(terms, "term").where(F.col("rank") <= TOP_TERMS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
