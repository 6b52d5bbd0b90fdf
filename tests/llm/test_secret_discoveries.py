"""Discoveries of the secret scan: ordinary names stay, keys of 20 to 64 characters are found, patterns are no keys."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import secrets

WORDS = ("session manager factory abstract bean request handler string encoding linux machine wide pull tool configuration http server "
         "internal buffer index writer reader socket timeout response header value default option thread parser stream error").split()
SHORT = ("NASA HTTP XML get_value HAVE_FOO setUp myName i18n utf8 NSString X11 sha256 CAN_BUS fooBar2 READ_ONLY").split()


def names(rng, count):
    """Names as code has them, all long enough to be candidates."""
    made = []
    while len(made) < count:
        parts = rng.choices(WORDS, k=rng.randrange(2, 5))
        style = rng.randrange(5)
        name = ("".join(p.capitalize() for p in parts), "_".join(parts).upper(), rng.choice(["NS", "XML", "Doc"]) + "".join(p.capitalize() for p in parts),
                parts[0] + "".join(p.capitalize() for p in parts[1:]) + str(rng.randrange(100)), "/".join(parts) + ".h")[style]
        if len(name) >= 22:
            made.append(name)
    return made


def keys(rng, count):
    made = []
    while len(made) < count:
        key = "".join(rng.choice(secrets.ENCODINGS[rng.choice(["base62", "base36", "base32", "base64url"])]) for _ in range(rng.randrange(20, 65)))
        if secrets.infer_encoding(key) and not secrets.base_spans(key):
            made.append(key)
    return made


@pytest.fixture(scope="module")
def corpus(spark):
    """3,000 texts: ten names each in prose, and a key in every tenth; one source of copies holds a third of the keys."""
    rng = random.Random(21)
    planted, texts = keys(rng, 300), []
    for i in range(3000):
        words = rng.choices(WORDS, k=60) + names(rng, 10) + rng.choices(SHORT, k=6)
        rng.shuffle(words)
        if i % 10 == 0:
            words.insert(rng.randrange(len(words)), planted[0] if i % 30 == 0 else planted[i // 10])
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    return texts, planted, docs


def test_names_stay_and_keys_are_found(corpus):
    texts, planted, docs = corpus
    found, kept = Counter(), set(planted)
    for row in secrets.scan_secrets(docs).collect():
        for span in row["spans"].split(","):
            if span.startswith("random:"):
                _, start, end = span.split(":")
                found[texts[row["doc_id"]][int(start):int(end)] in kept or any(texts[row["doc_id"]][int(start):int(end)] in k for k in kept)] += 1
    assert found[True] >= 0.97 * 300
    assert found[False] <= 0.02 * sum(found.values()), found  # 30,000 names, the bound asked for is 1 % of what is reported


def test_without_ordinary_text_names_would_be_reported(corpus):
    """The battery alone lets many short names pass: the bound comes from the chain and the step."""
    texts, planted, _ = corpus
    candidates = [w for t in texts[:600] for w in t.split() if len(w) >= 20 and w not in planted and secrets.infer_encoding(w)]
    passed = sum(secrets.randomness_p(w) >= secrets.LOST for w in candidates)
    assert passed > 200


def test_patterns_unlike_text_are_no_keys(corpus):
    _, _, docs = corpus
    rule = secrets.discovery_rule(docs)
    for token in ("aB3" * 12, "0f1e" * 5 + "0f1X", "Q9zX" * 10, "A1" * 20):
        assert secrets.randomness_p(token) < secrets.LOST and -4.16 * len(token) > rule.chain.log_likelihood(token)
        assert secrets.spans_of(f"see {token} here", rule) == []


def test_parts_beside_base_spans_and_between_separators(corpus):
    _, _, docs = corpus
    rule = secrets.discovery_rule(docs)
    rng = random.Random(8)
    for _ in range(50):
        key = "".join(rng.choice(secrets.ENCODINGS["base62"]) for _ in range(40))
        digest = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        text = f"deploy/{digest}/X{key}"
        at = text.index(key) - 1
        assert (at, 3, len(text)) in [(max(a, at), k, b) for a, k, b in secrets.spans_of(text, rule)]
        assert (7, 2) in [s[:2] for s in secrets.spans_of(text, rule)]
        text = f"internal/request/handler/{key}/session"
        assert [(a, b) for a, _, b in secrets.spans_of(text, rule)] == [(25, 65)]


def test_open_parts_are_the_runs_without_base_spans():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("ab/ =") if rng.random() < 0.1 else "k" for _ in range(300))
        base = sorted((a, 0, a + rng.randrange(1, 90)) for a in (rng.randrange(250) for _ in range(rng.randrange(5))))
        free = ["." if any(a <= i < b for a, _, b in base) else c for i, c in enumerate(text)]
        assert list(secrets._open_parts(text, base)) == [m.span() for m in secrets.LONG_RUN.finditer("".join(free))]


def test_chain_counts_equal_a_plain_count():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abZ09_/ é\n") for _ in range(rng.randrange(200))) for _ in range(100)] + ["", None, "x" * 25 + " y", "é"]
    plain = np.zeros(secrets.CLASS_CELLS + secrets.LETTER_CELLS, int)
    for text in texts:
        for run in secrets.re.findall(r"[A-Za-z0-9+/_-]+", text or ""):
            state, letter = (4, 4), 26
            for c in run if len(run) < secrets.MIN_LENGTH else "":
                now = secrets._char_class(c)
                plain[(state[0] * 5 + state[1]) * 4 + now] += 1
                if c.isalpha():
                    word = letter if (state[1], now) != (1, 2) else 26
                    plain[secrets.CLASS_CELLS + word * 26 + ord(c.lower()) - 97] += 1
                state, letter = (state[1], now), ord(c.lower()) - 97 if c.isalpha() else 26
    for size in (1 << 20, 50):
        kept, secrets.SLICE = secrets.SLICE, size
        try:
            assert (sum(map(secrets.chain_counts, secrets._slices(iter(texts)))) == plain).all()
        finally:
            secrets.SLICE = kept


def test_step_equals_its_definition():
    rng = random.Random(6)
    for _ in range(300):
        items = [(rng.randrange(0, 80), rng.randrange(20, 65)) for _ in range(rng.randrange(1, 60))]
        bins = {}
        for at, weight in items:
            n, w = bins.get(at, (0, 0))
            bins[at] = n + 1, w + weight
        mean = sum(w for _, w in items) / len(items)
        strengths = sorted((10 ** (at / 10) / mean for at, _ in items if at), reverse=True)
        k = max((k for k, e in enumerate(strengths, 1) if e >= len(items) / (0.01 * k)), default=0)
        cut = secrets.first_reported([(at, n, w) for at, (n, w) in bins.items()], 0.01)
        assert sum(at >= cut for at, _ in items) >= k and (k or cut > secrets.BINS)
    assert secrets.first_reported([]) > secrets.BINS


def test_nothing_is_reported_from_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.discovery_rule(empty).cut > secrets.BINS
    wordless = empty.unionByName(spark.range(5).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    assert {r["spans"] for r in secrets.scan_secrets(wordless).collect()} == {""}
    assert math.isfinite(secrets.discovery_rule(wordless).chain.log_likelihood("aB3_x"))
