"""Secret scan: fixed patterns, and a battery of randomness tests for everything else.

A candidate is a run of 20 or more key characters, outside the spans of the
fixed patterns, from which a byte encoding can be inferred; where it holds
separators, its parts of 20 or more characters are candidates too.  Three tests
ask whether its symbols are drawn evenly from the encoding's alphabet:
chi-squared uniformity, the number of runs of character classes, and the
lag-one serial correlation; Fisher's method combines them.  A candidate that
fails is patterned or ordinary, and let go; a key fails with probability
``LOST``.

One that passes may still be a name too short for the tests.  The null
hypothesis of a discovery is therefore that it is ordinary text, which a chain
of character classes and letter pairs describes, counted over all shorter runs
of the corpus.  The likelihood of the even draw over that of the chain has mean
one under this hypothesis (an e-value).  Weighted by length, with mean one, the
e-values of the whole corpus pass a Benjamini-Hochberg step that holds under
any dependence, so copies do no harm: of the candidates reported as kind
``random``, a share of ``q`` at most is expected to be ordinary text.

The chain has fewer than 1,000 counts and the step reads a histogram of at most
``BINS`` + 1 rows, whatever the input.  The texts are read three times and
never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in their order, and the patterns of the three base kinds.  A run of 20 or more characters
# that starts with the access prefix, and one of 24 or more hexadecimal digits, are found as such at once.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

MIN_LENGTH = 20  # shorter runs give the battery no power against ordinary words
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH)
LOST = 0.001  # share of keys that the battery lets go
FALSE = 0.01  # expected share of ordinary text among what is reported
MOST_WEIGHT = 64  # the weight of a candidate is its length up to this, over the mean of all

# Alphabets in the order of symbol values, smallest first: the first that holds all characters is inferred.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_VALUES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
BINS, BINS_PER_DECADE = 1000, 10
_PARTS = re.compile(r"[^/_+-]{%d,}" % MIN_LENGTH)

# The chain of ordinary text: a class given the two before it, then a letter given the letter before it in its word.
# Class 4 stands before the first character of a run, letter 26 before that of a word and for whatever is no letter.
START, NO_LETTER = 4, 26
STAY = 0.8  # before anything is counted, a run keeps its class with this probability
NOVEL = 0.1  # share of ordinary text that follows no pair of the corpus, so that a new name costs little in a corpus of any size
_CLASS_OF = np.full(256, -1, np.int8)
_LETTER_OF = np.full(256, NO_LETTER, np.int8)
for _at, _chars in enumerate((_DIGITS, _LOWER, _UPPER, "+/_-")):
    _CLASS_OF[[ord(c) for c in _chars]] = _at
for _letters in (_LOWER, _UPPER):
    _LETTER_OF[[ord(c) for c in _letters]] = np.arange(26)
CLASS_CELLS, LETTER_CELLS = 5 * 5 * 4, 27 * 26
SLICE = 1 << 20  # bytes that are counted at a time


def _char_class(c: str) -> int:
    return 0 if c in _DIGITS else 1 if c in _LOWER else 2 if c in _UPPER else 3


def _class_shares(alphabet: str) -> list[float]:
    return [sum(_char_class(c) == k for c in alphabet) / len(alphabet) for k in range(4)]


_SHARES = {name: _class_shares(alphabet) for name, alphabet in ENCODINGS.items()}


def infer_encoding(token: str) -> str | None:
    """Smallest alphabet that holds the token; None for digits only or letters of one case only."""
    used = frozenset(token)
    if used <= _SETS["hex"] and used <= frozenset(_DIGITS) or used <= frozenset(_LOWER) or used <= frozenset(_UPPER):
        return None
    return next((name for name, letters in _SETS.items() if used <= letters), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity_p(values: list[int], size: int) -> float:
    """Chi-squared uniformity over the alphabet, upper tail, with the exact mean and variance of sparse counts."""
    n, counts = len(values), {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    statistic = size / n * sum(c * c for c in counts.values()) - n
    mean, variance = size - 1.0, 2.0 * (size - 1) * (n - 1) / n
    degrees = 2 * mean * mean / variance  # of the scaled chi-squared with this mean and variance
    spread = 2 / (9 * degrees)
    return _normal_tail(((max(statistic, 0.0) / mean) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def runs_p(token: str, shares: list[float]) -> float:
    """Number of changes between character classes against the alphabet's own shares, both tails."""
    n = len(token)
    kinds = [_char_class(c) for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    change = 1 - sum(p * p for p in shares)
    both = sum(p * (1 - p) ** 2 for p in shares)
    variance = (n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change * change)
    return math.erfc(abs(changes - (n - 1) * change) / math.sqrt(2 * max(variance, 1e-9)))


def serial_p(values: list[int]) -> float:
    """Lag-one circular correlation of the symbol values, both tails."""
    n, mean = len(values), sum(values) / len(values)
    centred = [v - mean for v in values]
    power = sum(v * v for v in centred)
    if power == 0:
        return 0.0
    correlation = sum(a * b for a, b in zip(centred, centred[1:] + centred[:1])) / power
    return math.erfc(abs(correlation + 1 / (n - 1)) * math.sqrt(n / 2))


def randomness_p(token: str) -> float | None:
    """Combined p-value of the battery for 'drawn evenly'; None if no encoding can be inferred."""
    name = infer_encoding(token)
    if name is None:
        return None
    values = [_VALUES[name][c] for c in token]
    half = -sum(math.log(max(p, 1e-300)) for p in
                (uniformity_p(values, len(ENCODINGS[name])), runs_p(token, _SHARES[name]), serial_p(values)))
    return math.exp(-half) * (1 + half + half * half / 2)


def chain_counts(text: bytes) -> np.ndarray:
    """Classes by the two before them, then letters by the one before, over all runs shorter than a candidate."""
    codes = np.frombuffer(text, np.uint8)
    kinds = _CLASS_OF[codes]
    inside = np.flatnonzero(kinds >= 0)
    if not len(inside):
        return np.zeros(CLASS_CELLS + LETTER_CELLS, np.int64)
    first = np.concatenate([[True], np.diff(inside) > 1])
    run = np.cumsum(first) - 1
    short = np.bincount(run)[run] < MIN_LENGTH
    inside, first = inside[short], first[short]
    now, letter = kinds[inside].astype(np.int64), _LETTER_OF[codes[inside]].astype(np.int64)
    before = np.where(first, START, np.roll(now, 1))
    earlier = np.where(first, START, np.roll(before, 1))
    letter_before = np.where(first | ((before == 1) & (now == 2)), NO_LETTER, np.roll(letter, 1))
    is_letter = letter < NO_LETTER
    return np.concatenate([np.bincount((earlier * 5 + before) * 4 + now, minlength=CLASS_CELLS),
                           np.bincount((letter_before * 26 + letter)[is_letter], minlength=LETTER_CELLS)])


def _slices(texts: Iterator[str | None]) -> Iterator[bytes]:
    """Texts joined by line ends, in slices of about ``SLICE`` bytes that end between runs."""
    waiting, size = [], 0
    for text in texts:
        value = (text or "").encode("utf-8", "replace")
        at = 0
        while len(value) - at > SLICE:
            end = value.find(b" ", at + SLICE)
            if end < 0:
                break
            yield value[at:end]
            at = end
        waiting.append(value[at:])
        size += len(value) - at
        if size > SLICE:
            yield b"\n".join(waiting)
            waiting, size = [], 0
    yield b"\n".join(waiting)


@dataclass(frozen=True)
class Chain:
    """Logarithms of the probabilities of ordinary text."""
    classes: list[list[list[float]]]  # by earlier class, class before, class
    letters: list[list[float]]  # by letter before, letter

    @staticmethod
    def of(counts: np.ndarray) -> Chain:
        classes = counts[:CLASS_CELLS].reshape(5, 5, 4).astype(float)
        keep = np.array([[STAY if before == k else (1 - STAY) / 3 for k in range(4)] if before < START else [0.25] * 4 for before in range(5)])
        letters = counts[CLASS_CELLS:].reshape(27, 26).astype(float)
        usual = (letters.sum(0) + 1) / (letters.sum() + 26)
        return Chain(*(np.log(NOVEL * prior + (1 - NOVEL) * (n + prior) / (n.sum(-1, keepdims=True) + 1)).tolist()
                       for n, prior in ((classes, keep), (letters, usual))))

    def log_likelihood(self, token: str) -> float:
        total, earlier, before, letter_before = 0.0, START, START, NO_LETTER
        for c in token:
            now, letter = int(_CLASS_OF[ord(c)]), int(_LETTER_OF[ord(c)])
            total += self.classes[earlier][before][now]
            if letter < NO_LETTER:
                total += self.letters[NO_LETTER if before == 1 and now == 2 else letter_before][letter]
            else:
                total -= math.log(10 if now == 0 else 4)
            earlier, before, letter_before = before, now, letter
        return total


def fit_chain(docs: DataFrame, text: str = "text") -> Chain:
    """The chain of all texts: one scan, each task sends at most one row for each of its cells."""
    def counted(batches):
        counts = np.zeros(CLASS_CELLS + LETTER_CELLS, np.int64)
        for part in _slices(value.as_py() for batch in batches for value in batch.column(0)):
            counts += chain_counts(part)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(counts[cells], pa.int64())], ["cell", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASS_CELLS + LETTER_CELLS, np.int64)
    for row in rows:
        counts[row["cell"]] = row["n"]
    return Chain.of(counts)


def evidence(token: str, chain: Chain) -> float | None:
    """Natural logarithm of the e-value for 'drawn evenly' against ordinary text.

    Minus infinity where the battery speaks against an even draw, None if no encoding can be inferred.
    """
    name = infer_encoding(token)
    if name is None:
        return None
    if randomness_p(token) < LOST:
        return -math.inf
    return -len(token) * math.log(len(ENCODINGS[name])) - chain.log_likelihood(token)


def evidence_bin(token: str, log_e: float) -> int:
    """Bin of the e-value times its weight on a logarithmic scale, rounded down; 0 holds all that says nothing."""
    if log_e == -math.inf:
        return 0
    return max(0, min(BINS, math.floor((log_e + math.log(min(len(token), MOST_WEIGHT))) / math.log(10) * BINS_PER_DECADE)))


@dataclass(frozen=True)
class Rule:
    """What decides on a candidate: ordinary text, and the first bin that is reported."""
    chain: Chain
    cut: int


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three base kinds in one text."""
    spans = []
    folded = text.lower()
    if any(word in folded for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    for run in LONG_RUN.finditer(text):
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, run.start(), run.end())]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end())]
    return sorted(spans)


def _open_parts(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters without what base spans cover, where 20 or more characters are left."""
    spans, reached = sorted((start, end) for start, _, end in base), 0
    for run in LONG_RUN.finditer(text):
        at = run.start()
        while reached < len(spans) and spans[reached][0] < run.end():
            start, end = spans[reached]
            if start - at >= MIN_LENGTH:
                yield at, start
            at = max(at, end)
            if end > run.end():  # it may reach into the next run as well
                break
            reached += 1
        if run.end() - at >= MIN_LENGTH:
            yield at, run.end()


Candidate = tuple[int, int, float]  # start, end, evidence


def _candidates(text: str, base: list[tuple[int, int, int]], chain: Chain) -> Iterator[tuple[list[Candidate], list[Candidate]]]:
    """For each open part: itself, if it is a candidate, and the candidates that separators leave of it."""
    def scored(places: list[tuple[int, int]]) -> list[Candidate]:
        return [(a, b, e) for a, b in places if (e := evidence(text[a:b], chain)) is not None]

    for start, end in _open_parts(text, base):
        parts = [m.span() for m in _PARTS.finditer(text, start, end)]
        yield scored([(start, end)]), scored([p for p in parts if p != (start, end)])


def spans_of(text: str | None, rule: Rule | None) -> list[tuple[int, int, int]]:
    """All spans of a text: the base kinds, and the candidates that the rule reports (none without a rule).

    Of an open part, either itself or its smaller candidates are reported, whichever has more evidence.
    """
    if not text:
        return []
    base = base_spans(text)
    found: list[Candidate] = []
    for pair in _candidates(text, base, rule.chain) if rule else ():
        whole, parts = ([c for c in group if evidence_bin(text[c[0]:c[1]], c[2]) >= rule.cut] for group in pair)
        found += whole if whole and whole[0][2] > sum(e for *_, e in parts) else parts
    return sorted(base + [(start, 3, end) for start, end, _ in found])


def _bins(text: Column, chain: Chain) -> Column:
    """(bin, weight) of every candidate of a text."""
    @F.pandas_udf("array<struct<bin: int, weight: int>>")
    def bins(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: [(evidence_bin(value[a:b], e), min(b - a, MOST_WEIGHT))
                                        for pair in _candidates(value, base_spans(value), chain)
                                        for group in pair for a, b, e in group] if value else [])
    return bins(text)


def first_reported(bins: list[tuple[int, int, int]], q: float = FALSE) -> int:
    """First bin that is reported, from (bin, candidates, sum of their weights).

    The Benjamini-Hochberg step for e-values over all candidates: the largest
    k of them with a weighted e-value of at least candidates / (q k), each
    counted at the lower edge of its bin.  As weights are divided by their mean,
    the number of candidates becomes the sum of weights.  Bin 0 is never reported.
    """
    weight, so_far, cut = sum(w for *_, w in bins), 0, BINS + 1
    for at, n, _ in sorted(bins, reverse=True):
        so_far += n
        if at and 10 ** (at / BINS_PER_DECADE) >= weight / (q * so_far):
            cut = at
    return cut


def discovery_rule(docs: DataFrame, text: str = "text", q: float = FALSE) -> Rule:
    """The rule that the whole corpus sets; two scans, at most ``BINS`` + 1 rows collected.

    Without candidates, or without evidence, nothing is reported.
    """
    chain = fit_chain(docs, text)
    found = docs.select(F.explode(_bins(F.col(text), chain)).alias("c"))
    rows = found.groupBy("c.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c.weight").alias("weight")).collect()
    return Rule(chain, first_reported([(r["bin"], r["n"], r["weight"]) for r in rows], q))


def _scanner(rule: Rule):
    @F.pandas_udf(T.StringType())
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans_of(text, rule)))
    return scan


def scan_secrets(docs: DataFrame, text: str = "text", q: float = FALSE, name: str = "spans") -> DataFrame:
    """Add ``name``: ``kind:start:end`` of every span, comma-joined, by start and then kind.

    Code points, end exclusive.  A null or empty text has no span (empty
    string).  Equal texts give equal spans; texts of any length are read
    whole.  A column that is already called ``name`` is replaced.  On an empty
    table the result is empty.
    """
    return docs.withColumn(name, _scanner(discovery_rule(docs, text, q))(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text", q: float = FALSE) -> DataFrame:
    """Replace every span in the text by ``[kind]``; overlapping spans become one mark.

    Rows, order of columns and null texts stay; ``n_chars`` follows the new
    text where the column exists.
    """
    rule = discovery_rule(docs, text, q)

    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: redacted(value, rule))

    clean = docs.withColumn(text, redact(F.col(text)))
    return clean.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else clean


def redacted(text: str | None, rule: Rule | None) -> str | None:
    if not text:
        return text
    pieces, at, reach = [], 0, 0
    for start, kind, end in spans_of(text, rule):
        if start >= reach:
            pieces += [text[at:start], f"[{KINDS[kind]}]"]
        reach = at = max(reach, end)
    return "".join(pieces) + text[at:]


def count_of(spans: Column, kind: str) -> Column:
    """Number of spans of one kind in the joined form."""
    return F.regexp_count(spans, F.lit(f"(^|,){kind}:")).cast("long")


def base_of(spans: Column) -> Column:
    """The joined form without the spans that the tests added."""
    return F.array_join(F.filter(F.split(spans, ","), lambda s: ~s.startswith("random:")), ",")
