"""PII with a semi-Markov conditional random field, beside exact base detectors.

The base kinds (email, ip, card, phone) are found by their patterns, leftmost and without overlap. The
field reads a text's tokens: segments of up to LONGEST tokens are scored by features of the whole span (number and lengths of its digit groups, separators,
first digits, Luhn sum, octets, domain shape, the cue word before it) for each type, and dynamic programming bounded by LONGEST chooses the boundaries and
the types together. An entity holds a digit, an at sign or its spelling (the model gives other segments no
type but outside), so every token further than LONGEST - 1 tokens from such a one is outside: the programme runs over
each stretch of nearer tokens, with the token that follows it, and gives what it would give over the whole text.
Its spans that touch no base span are added.

The weights are trained here: gradient ascent on the conditional likelihood (forward-backward over segments)
of sequences that a seeded generator writes, with entities in several spellings among words and numbers that
are none. No corpus text is needed, so the fit is the same at every size.

Defined cases: a null text is empty; offsets are code points; equal texts and repeated rows get equal values;
a part of an address or a number of any length is read without converting it; other columns are not read."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
LONGEST = 6
TRAIN = 400
EPOCHS = 6
SEED = 3

# The base patterns. The look-behinds and possessive counts only spare repeated attempts.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str) -> list[tuple[int, int]]:
    """A match's local part is the run of its characters before an at sign, down to the last match's end."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]|(?<![^\s])dot(?![^\s])")
_REST = re.compile(r"\S*+")
_EDGE = " \t\r\n\"'<>,;:!?()[]{}|"
_GROUP = re.compile(r"[0-9]+")
_MAIL_LIKE = re.compile(r"\S+(?: at | ?(?:@|\(at\)|\[at\]) ?)\S+(?:(?: dot | ?(?:\.|\(dot\)|\[dot\]) ?)[A-Za-z]{2,})+$")
_CUES = {"email": 0, "mail": 0, "ip": 1, "host": 1, "address": 1, "card": 2, "visa": 2, "phone": 3, "tel": 3, "call": 3, "fax": 3, "mobile": 3}
#: Words before numbers that are no personal data.
_OTHER = frozenset("invoice order score scores iban isbn ssn account version date ref reference ticket issue item part serial page".split())
_MARKS = "- ./():,"
#: Where the features of the span's shape begin, and buckets of its groups' lengths.
_SHAPE, _LENGTHS = 24, 256
_DOMAIN_END = _SHAPE + 40 + _LENGTHS
_N = _DOMAIN_END + 1
_ENDS = (".com", ".org", ".net", ".edu", ".gov", ".info", ".io", ".de", ".fr", ".es", ".it", ".uk", ".eu", " com", " org", " net", " edu", " de", " fr", " es", "]com", ")com")
_NONE = 18  # of a segment that can be no entity


def features(span: str, before: str, tokens: int) -> list[int]:
    """Numbers of the features that a whole span has."""
    core = span.strip(_EDGE)
    groups = _GROUP.findall(core)
    n = sum(map(len, groups))
    out = [0, min(tokens, LONGEST)]
    letters = any(map(str.isalpha, core))
    out.append(7 if letters else 8)
    if len(core) <= 254 and _MAIL_LIKE.match(core):
        out.append(9)
        if core.lower().endswith(_ENDS):
            out.append(_DOMAIN_END)
    if "@" in core:
        out.append(10)
    if len(groups) == 4 and not letters and all(_octet(g) for g in groups) and core.count(".") == 3:
        out.append(11)
    if not letters and 16 <= n <= 19:
        out.append(12)
        if luhn("".join(groups)):
            out.append(13)
    if core.startswith("+") and not letters and 8 <= n <= 15:
        out.append(14)
    if not letters and 9 <= n <= 12 and 3 <= len(groups) <= 5 and core[:1] in "(0123456789" and not core.count(".") == 3:
        out.append(15)
    if n and n < 8:
        out.append(16)
    if n > 19:
        out.append(17)
    if not _TRIGGER.search(span):
        out.append(_NONE)
    cue = _CUES.get(before.lower().strip(_EDGE))
    if cue is not None:
        out.append(19 + cue)
    if len(core) > 120:
        out.append(23)
    elif n:
        out += _shape(core, groups, n, letters)
    if before.lower().strip(_EDGE) in _OTHER:
        out.append(_SHAPE + 39)
    return out


def _shape(core: str, groups: list[str], n: int, letters: bool) -> list[int]:
    """Digits and groups, separators among them, how they begin, and the groups' lengths in a row."""
    out = [_SHAPE + min(n, 19), _SHAPE + 20 + min(len(groups), 6)]
    out += [_SHAPE + 27 + i for i, c in enumerate(_MARKS) if c in core]
    if groups[0][0] == "0":
        out.append(_SHAPE + 35)
    if any(len(g) == 4 and g[:2] in ("19", "20") for g in groups):
        out.append(_SHAPE + 36)
    if len(groups) > 1:
        out.append(_SHAPE + (37 if len({len(g) for g in groups}) == 1 else 38))
    if not letters:
        out.append(_SHAPE + 40 + zlib.crc32(",".join(str(min(len(g), 9)) for g in groups).encode()) % _LENGTHS)
    return out


def _segments(text: str, spans: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    """Features of each segment [i, j) of up to LONGEST tokens."""
    words = [text[a:b] for a, b in spans]
    return {
        (i, j): features(text[spans[i][0] : spans[j - 1][1]], words[i - 1] if i else "", j - i)
        for i in range(len(spans)) for j in range(i + 1, min(len(spans), i + LONGEST) + 1)
    }


def _scores(segs: dict, w: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Score of each segment for each type; type 0 (outside) has one token."""
    out = {}
    for (i, j), f in segs.items():
        out[i, j] = _allowed(w[:, f].sum(axis=1), f, j - i)
    return out


def _allowed(s: np.ndarray, f: list[int], tokens: int) -> np.ndarray:
    """Scores by type with -inf for what the model rules out: several tokens as one outside, an entity without a trigger."""
    if tokens > 1:
        s[0] = -np.inf
    if _NONE in f:
        s[1:] = -np.inf
    return s


def viterbi(n: int, score: dict | _Scores, trans: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation: (type, i, j) in order."""
    kinds = len(KINDS) + 1
    last = np.full(kinds, -np.inf)
    last[0] = 0.0
    via, prev = np.empty((n + 1, kinds)), np.empty((n + 1, kinds), np.int8)
    start, of = np.empty((n + 1, kinds), np.int64), np.arange(kinds)
    for j in range(1, n + 1):
        step = last[:, None] + trans
        via[j - 1], prev[j - 1] = step.max(axis=0), step.argmax(axis=0)
        lo = max(0, j - LONGEST)
        total = via[lo:j] + np.stack([score[i, j] for i in range(lo, j)])
        first = total.argmax(axis=0)
        last, start[j] = total[first, of], first + lo
    out, j, y = [], n, int(last.argmax())
    while j:
        i = int(start[j, y])
        out.append((y, i, j))
        j, y = i, int(prev[i, y])
    return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis))


def _gradient(n: int, segs: dict, gold: list[tuple[int, int, int]], w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected counts of features and transitions."""
    kinds = len(KINDS) + 1
    score = _scores(segs, w)
    fore, rear = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
    fore[0, 0], rear[n] = 0.0, 0.0
    for j in range(1, n + 1):
        fore[j] = _lse(np.stack([_lse(fore[i][:, None] + trans, 0) + score[i, j] for i in range(max(0, j - LONGEST), j)]), 0)
    for i in range(n - 1, -1, -1):
        rear[i] = _lse(np.stack([_lse(trans + (score[i, j] + rear[j])[None, :], 1) for j in range(i + 1, min(n, i + LONGEST) + 1)]), 0)
    z = _lse(fore[n], 0)
    gw, gt = np.zeros_like(w), np.zeros_like(trans)
    for (i, j), f in segs.items():
        p = np.exp(fore[i][:, None] + trans + (score[i, j] + rear[j])[None, :] - z)
        gt -= p
        gw[:, f] -= p.sum(axis=0)[:, None]
    last = 0
    for y, i, j in gold:
        gw[y, segs[i, j]] += 1
        gt[last, y] += 1
        last = y
    return gw, gt


def _example(rng: random.Random) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Tokens and gold segments: words, numbers that are nothing, and at times an entity."""
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(2, 8)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    tokens: list[str] = []
    gold: list[tuple[int, int, int]] = []

    def put(text: str, kind: int) -> None:
        parts = text.split(" ")
        steps = [(kind, len(tokens), len(tokens) + len(parts))] if kind else [(0, len(tokens) + i, len(tokens) + i + 1) for i in range(len(parts))]
        gold.extend(steps)
        tokens.extend(parts)

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        near = rng.choice([f"0{digits(2)}-{digits(7)}", f"0{digits(3)}/{digits(7)}", f"0{digits(2)} {digits(8)}", f"(0{digits(2)}) {digits(7)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(3)} {digits(6)}"])
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", near, near])

    def email() -> str:
        return rng.choice([f"{word()}.{digits(2)}@{word()}.com", f"{word()}@{word()}.{word()}.org", f"{word()} (at) {word()}.com", f"{word()} [at] {word()} [dot] com", f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net', 'de'])}"])

    def year() -> str:
        return f"{rng.choice(['19', '20'])}{digits(2)}-" + rng.choice([f"{digits(6)}-{digits(2)}", f"{digits(5)}", f"{digits(3)}-{digits(4)}"])

    def account() -> str:
        """A country, two digits and groups of four, as account numbers are written."""
        return f"{word()[:2].upper()}{digits(2)} " + " ".join(digits(4) for _ in range(rng.randint(3, 5))) + rng.choice(["", f" {digits(2)}", f" {digits(3)}"])

    def wrong() -> str:
        """Grouped as a card, with another sum."""
        d = digits(15)
        d += next(c for c in rng.sample("0123456789", 10) if not luhn(d + c))
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    entities = (email, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, phone)
    others = (lambda: digits(rng.randint(1, 6)), lambda: f"{digits(1)}.{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
              lambda: ".".join(digits(1) for _ in range(3)), lambda: digits(rng.randint(20, 40)), lambda: "@" + word(), lambda: word() + digits(2),
              lambda: f"{digits(2)}:{digits(2)}", lambda: "".join(rng.choices("0123456789abcdef", k=32)), lambda: digits(13), year, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
              lambda: " ".join(digits(3) for _ in range(rng.randint(2, 6))), wrong, wrong,
              lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{word()} dot {word()}", lambda: f"{digits(3)}-{digits(6)}",
              lambda: f"{word()} at {word()} dot {word()}", lambda: " ".join(digits(rng.choice([1, 2])) for _ in range(rng.randint(3, 6))), account, account)
    for _ in range(rng.randint(1, 3)):
        put(word(), 0)
    for _ in range(rng.randint(1, 2)):
        if rng.random() < 0.6:
            k = rng.randrange(4)
            if rng.random() < 0.2:
                put(rng.choice([c for c, v in _CUES.items() if v == k]), 0)
            put(entities[k](), k + 1)
        else:
            if rng.random() < 0.2:
                put(rng.choice(sorted(_OTHER)), 0)
            put(rng.choice(others)(), 0)
        for _ in range(rng.randint(1, 2)):
            put(word(), 0)
    return tokens, gold


def _located(tokens: list[str]) -> tuple[str, list[tuple[int, int]]]:
    text = " ".join(tokens)
    return text, [m.span() for m in _TOKEN.finditer(text)]


@functools.cache
def train(size: int = TRAIN, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights (types x features) and transitions of the field."""
    rng = random.Random(seed)
    data = []
    for _ in range(size):
        tokens, gold = _example(rng)
        text, spans = _located(tokens)
        data.append((len(spans), _segments(text, spans), gold))
    kinds = len(KINDS) + 1
    w, trans = np.zeros((kinds, _N)), np.zeros((kinds, kinds))
    for epoch in range(epochs):
        rng.shuffle(data)
        for n, segs, gold in data:
            gw, gt = _gradient(n, segs, gold, w, trans)
            rate = 0.3 / (1 + epoch)
            w += rate * (gw - 1e-3 * w)
            trans += rate * (gt - 1e-3 * trans)
    return w, trans


def _triggers(text: str) -> list[tuple[int, int]]:
    """Tokens that hold a digit, an at sign or its spelling."""
    out, at = [], 0
    while m := _TRIGGER.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        at = _REST.match(text, m.end()).end()
        out.append((start, at))
    return out


class _Scores:
    """Scores of the segments of tokens lo to hi as viterbi asks for them; the word before each is seen."""

    def __init__(self, text: str, spans: list[tuple[int, int]], lo: int, w: np.ndarray):
        self.text, self.spans, self.lo, self.w = text, spans, lo, w

    def __getitem__(self, at: tuple[int, int]) -> np.ndarray:
        i, j = at[0] + self.lo, at[1] + self.lo
        before = self.text[slice(*self.spans[i - 1])] if i else ""
        f = features(self.text[self.spans[i][0] : self.spans[j - 1][1]], before, j - i)
        return _allowed(self.w[:, f].sum(axis=1), f, j - i)


def _windows(text: str, every: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """[lo, hi) of the tokens within LONGEST - 1 of a trigger and the next, which is outside; what meets is one
    window, whatever its length."""
    out: list[tuple[int, int]] = []
    for mark in _triggers(text):
        k = bisect.bisect_left(every, mark)
        lo, hi = max(0, k - LONGEST + 1), min(len(every), k + LONGEST + 1)
        if out and lo <= out[-1][1]:
            lo = out.pop()[0]
        out.append((lo, hi))
    return out


def field_spans(text: str, w: np.ndarray, trans: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind number, start, end) that the field finds."""
    every = [m.span() for m in _TOKEN.finditer(text)]
    out = []
    for lo, hi in _windows(text, every):
        spans = every[lo:hi]
        for y, i, j in viterbi(len(spans), _Scores(text, every, lo, w), trans):
            if y:
                a, b = spans[i][0], spans[j - 1][1]
                while a < b and text[a] in _EDGE and text[a] != "(":
                    a += 1
                while b > a and (text[b - 1] in _EDGE or text[b - 1] == "."):
                    b -= 1
                if a < b:
                    out.append((y - 1, a, b))
    return out


def find(text: str | None, w: np.ndarray, trans: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the field's that touch no base span beside them."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    more = []
    for span in field_spans(text, w, trans):
        before = bisect.bisect_left(starts, span[2])  # base spans that begin before this one's end
        if not before or ends[before - 1] <= span[1]:
            more.append(span)
    return base, sorted({*base, *more})


def pii(docs: DataFrame) -> DataFrame:
    """The report for every row of (doc_id, text)."""
    w, trans = train()
    sent = docs.sparkSession.sparkContext.broadcast((w, trans))

    def run(batch: pa.RecordBatch) -> dict:
        counts = [[], [], [], []]
        sha, spans = [], []
        listed = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)
        for text in batch.column("text"):
            base, every = find(text.as_py(), *sent.value)
            for k in range(4):
                counts[k].append(sum(x[0] == k for x in base))
            sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(every))
        return {"doc_id": batch.column("doc_id"), "base_sha256": sha, "spans": spans} | {f"n_{k}": c for k, c in zip(KINDS, counts, strict=True)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
