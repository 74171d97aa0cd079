"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: an AND of ORs of trigrams that
any match must hold (folded to lower case). The index has, for each trigram that some query asks for,
the documents that hold it. A rule's candidates are the intersection of its postings, taken by
aggregating a document's postings (no text is moved for that), written, counted and joined to the texts: sent
to them where they are few, so no text is moved at all, else by a shuffle of both sides; then they are
verified with the rule's expression. A rule without mandatory trigrams scans every text.

Spans are code-point offsets: a text is cut at a rule's matches, and the lengths of the pieces and the
matches add up to each match's start. A match that fails its rule's length is dropped.

Defined cases: a null text is empty; a null doc_id is matched to its own postings (null-safe); rows that
repeat a doc_id share candidates, which are a superset for each, and each row is verified by itself; an empty
table gives an empty result; other columns are not read."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

try:
    import re._constants as _c
    import re._parser as _parser
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length is checked
    least: int = 0
    base: bool = False


# The patterns of the base kinds and of well-known public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
_MOST = 64
#: Trigrams asked of one literal; fewer is still a condition that every match meets.
_ASKED = 3
#: Matches of a text whose spans are put together at a time; the parts are joined once.
_PART = 256
_SPAN = "array<struct<start: int, rank: int, end: int, kind: string>>"


def _strings(tree) -> tuple[set[str] | None, list[set[str]]]:
    """Of a parsed expression: the strings that it can be (None where they are too many), lower-cased, and
    sets of strings of which any match holds one each."""
    run: set[str] = {""}
    entire, need = True, []
    for op, arg in tree:
        part, inner = _one(op, arg)
        need += inner
        if part is not None and len(run) * len(part) <= _MOST:
            run = {a + b for a in run for b in part}
            continue
        need.append(run)
        entire = False
        run = part if part is not None else {""}
    return (run, need) if entire else (None, [*need, run])


def _one(op, arg) -> tuple[set[str] | None, list[set[str]]]:
    if op is _c.LITERAL:
        return {chr(arg).lower()}, []
    if op is _c.IN:
        plain = all(kind is _c.LITERAL for kind, _ in arg)
        return ({chr(value).lower() for _, value in arg} if plain else None), []
    if op is _c.AT:
        return {""}, []
    if op is _c.SUBPATTERN:
        return _strings(arg[3])
    if op is _c.BRANCH:
        sides = [_strings(x) for x in arg[1]]
        known = all(s is not None for s, _ in sides)
        return (set().union(*(s for s, _ in sides)) if known else None), []
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
        low, high, body = arg
        one, inner = _strings(body)
        if one is not None and high <= 3:
            return {"".join(x) for n in range(low, high + 1) for x in product(one, repeat=n)}, inner if low else []
        return None, ([*inner, one] if one is not None else inner) if low else []
    return None, []


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """AND of ORs of ANDs of trigrams; empty where the expression has no mandatory trigram."""
    entire, need = _strings(_parser.parse(pattern))
    out = []
    for strings in [*need, *([entire] if entire is not None else [])]:
        if strings and all(len(s) >= 3 for s in strings):
            clause = []
            for s in sorted(s for s in strings if not any(t != s and t in s for t in strings)):
                grams = list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))
                pick = {0, len(grams) // 2, len(grams) - 1} if len(grams) > _ASKED else range(len(grams))
                clause.append([grams[i] for i in sorted(pick)])
            out.append(clause)
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id) for each of the trigrams that a text holds, case folded."""
    base = docs.select(F.col("doc_id"), F.lower("text").alias("low")).where("low IS NOT NULL")
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return base.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the rules whose queries a document's postings meet."""
    have = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))  # at most as many as are asked for

    def meets(rule: Rule) -> Column:
        each = [[F.size(F.array_except(F.array(*map(F.lit, grams)), "have")) == 0 for grams in clause] for clause in trigram_query(rule.pattern)]
        test = F.lit(True)
        for options in each:
            some = F.lit(False)
            for option in options:
                some = some | option
            test = test & some
        return test

    kinds = F.array_compact(F.array(*[F.when(meets(r), F.lit(r.kind)) for r in rules]))
    return have.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _found(text: Column, rule: Rule, rank: int, wanted: Column | None) -> Column:
    """Spans of a rule's matches in text."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, rule.pattern, -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(matches) / _PART).cast("int") - 1), lambda i: F.slice(pairs, i * _PART + 1, F.lit(_PART)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        size = F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) if rule.group else x["n"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + x["n"]).alias("at"), F.when(size >= rule.least, F.concat(acc["got"], F.array(span))).otherwise(acc["got"]).alias("got"))

    def part(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("got")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["got"], F.array(done["got"])).alias("got"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("got"))
    test = text.rlike(rule.pattern)
    return F.when(test if wanted is None else wanted & test, F.flatten(F.aggregate(parts, zero, part)["got"])).otherwise(F.array().cast(_SPAN))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Spans and counts for every row of (doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    asked = sorted({g for r in indexed for clause in trigram_query(r.pattern) for grams in clause for g in grams})
    cands = stored(candidates(postings(base, asked), indexed).withColumnRenamed("doc_id", "mate"), "candidates")
    joined = base.join(broadcast_if_small(cands), F.col("doc_id").eqNullSafe(F.col("mate")), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "kinds")
    found = [
        _found(F.col("text"), r, i, F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r in indexed else None)
        for i, r in enumerate(rules)
    ]
    spans = joined.select("doc_id", F.array_sort(F.concat(*found)).alias("all"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base_ranks = [i for i, r in enumerate(rules) if r.base]
    of = lambda i: lambda s: s["rank"] == i
    counts = [F.size(F.filter("all", of(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    return spans.select(
        "doc_id", *counts, F.sha2(listed(F.filter("all", lambda s: s["rank"].isin(base_ranks))), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
