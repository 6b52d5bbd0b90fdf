"""Clustering, byte-pair encoding and hard negatives against brute force and the public library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rosterlens.llm import bpe, negatives, queries, shallot
from tests.conftest import MEDIUM, SMALL
from tests.llm.test_text_operators import AWKWARD

VECTORS = "vec_id long, embedding array<double>, label int, near string, anchor int, n int"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary().ranks, special_tokens={})


def ids_of(data):
    return memoryview(bytes(data)).cast("I").tolist()


# --- encoding ------------------------------------------------------------------------

PARTS = ["a", "b", "é", "中文", "🎉", "\x00", " ", "  ", "\n", "\t ", "'", "'l", "l", "'re", "n't", "the", "ing", "1", "2345", ".", "...", "==",
         "aaaa", "<|endoftext|>", " ", " ", "x" * 40]


def test_ids_equal_the_library(library):
    rng, vocab = random.Random(4), bpe.vocabulary()
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(500)]
    for text in texts:
        ids = vocab.encode(text)
        assert ids_of(ids) == library.encode_ordinary(text), text
        assert vocab.decode(ids) == text.encode()


def test_every_prefix_has_its_own_encoding(library):
    vocab, rng = bpe.vocabulary(), random.Random(5)
    for _ in range(50):
        data = "".join(rng.choices(["e", "er", "ing", "th", "q", "zx", "st"], k=12)).encode()
        table = bpe.PrefixTable(vocab, data)
        for size in range(1, len(data) + 1):
            assert vocab.walk(table.last[:size]) == library._core_bpe.encode_single_piece(data[:size])


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 200_000, "x" + "\n" * 100_000 + "y", "ab" * 100_000, "word " * 60_000])
def test_long_runs_take_time_in_proportion(library, text):
    vocab = bpe.vocabulary()
    ids = vocab.encode(text)
    assert vocab.decode(ids) == text.encode() and ids_of(ids) == library.encode_ordinary(text)


def test_appends_and_edits_are_exact(library):
    rng = random.Random(6)
    for _ in range(400):
        text = bpe.TextEncoding("".join(rng.choices(PARTS, k=rng.randrange(0, 30))))
        for _ in range(6):
            start = rng.choice([rng.randrange(len(text.text) + 1), len(text.text)])
            end = rng.randrange(start, min(len(text.text), start + 6) + 1)
            put = "".join(rng.choices(PARTS, k=rng.randrange(0, 4)))
            expected = text.text[:start] + put + text.text[end:]
            text.replace(start, end, put)
            assert text.text == expected and text.ids() == library.encode_ordinary(expected)


def test_an_edit_encodes_its_neighbourhood_only(library):
    text = bpe.TextEncoding("the quick brown fox jumps " * 4000)
    before = text.encoded_bytes
    text.replace(50_000, 50_005, "zebra")
    text.append("s")
    assert text.encoded_bytes - before < 100 and text.ids() == library.encode_ordinary(text.text)
    run = bpe.TextEncoding("q" * 50_000)  # one piece: the table of its prefix is kept
    before = run.encoded_bytes
    run.append("rst")
    assert run.encoded_bytes - before == 3 and run.ids() == library.encode_ordinary("q" * 50_000 + "rst")


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_op12_equals_the_library_on_every_document(spark, library, folder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_encoding_of_awkward_rows(spark, library):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in AWKWARD], "doc_id long, text string, n_tokens int, ids string")
    rows = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for _, t in AWKWARD)
    both = bpe.encode_and_decode(docs).collect()
    assert sorted(ids_of(r["ids"]) for r in both) == sorted(library.encode_ordinary(t or "") for _, t in AWKWARD)
    assert bpe.encode_texts(docs.limit(0)).collect() == [] and bpe.encode_and_decode(docs.limit(0)).collect() == []


def test_revisions(spark, library):
    long = "some words of a text " * 3000
    rows = [(1, long, long[:30_000] + "changed" + long[30_004:]), (2, None, "new"), (3, "gone", None), (4, "same", "same"), (None, "a", "ab")]
    found = bpe.encode_revisions(spark.createDataFrame(rows, "doc_id long, before string, after string")).collect()
    for r, (_, before, after) in zip(sorted(found, key=lambda r: r["doc_id"] or 9), rows):
        assert ids_of(r["before_ids"]) == library.encode_ordinary(before or "") and ids_of(r["after_ids"]) == library.encode_ordinary(after or "")
        assert r["encoded_bytes"] < 100


# --- clustering ----------------------------------------------------------------------

def lloyd(rows, k, rounds, scale):
    """Plain Lloyd's rounds with Python integers; rows of (id, vector)."""
    exact = [[int(np.floor(scale * x)) for x in v] for _, v in rows]
    hashes = [(hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~", v) for (i, v) in rows]
    starts = sorted(range(len(rows)), key=lambda i: (hashes[i][0], list(hashes[i][1])))[:k]
    points = [exact[i] for i in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        chosen = [nearest(v)[1] for v in exact]
        for c in range(len(points)):
            own = [v for v, a in zip(exact, chosen) if a == c]
            if own:
                points[c] = [sum(column) // len(own) for column in zip(*own)]
    return sorted(((i if i is not None else -1), nearest(v)[1], nearest(v)[0]) for (i, _), v in zip(rows, exact)), points


def clustered(spark, rows, k, rounds, dim, scale=1024):
    table = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECTORS).repartition(3)
    members, centroids = shallot.cluster_vectors(table, k=k, rounds=rounds, dim=dim, scale=scale)
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"]) for r in members.collect())
    return got, centroids.orderBy("cluster").collect()


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(20, 6)) * 3
    rows = [(i, (middles[i % 20] + rng.normal(size=6)).tolist()) for i in range(900)]
    rows += [(i, [0.5] * 6) for i in range(900, 1200)]  # copies
    rows += [(i, [float(i % 3 - 1)] * 6) for i in range(1200, 1230)] + [(5, rows[5][1]), (None, rows[6][1])]
    got, centroids = clustered(spark, rows, 20, 6, 6)
    expected, points = lloyd(rows, 20, 6, 1024)
    assert got == expected
    assert [[int(x) for x in r["centroid"]] for r in centroids] == points
    # The bounds and the ball leave out much of what comparing all would read.
    assert centroids[0]["read"] < 0.6 * 7 * 20 * len(rows)


def test_ties_empty_clusters_and_few_vectors(spark):
    same = [(i, [0.25, -0.25]) for i in range(40)]  # all starts are equal: the first takes all, the others stay empty
    got, centroids = clustered(spark, same, 8, 3, 2)
    assert got == lloyd(same, 8, 3, 1024)[0] and [r["n"] for r in centroids] == [40] + [0] * 7
    few = [(i, [float(i), 1.0]) for i in range(3)]
    assert clustered(spark, few, 8, 2, 2)[0] == lloyd(few, 8, 2, 1024)[0]
    assert clustered(spark, [(7, [1.0, 2.0])], 8, 2, 2)[0] == [(7, 0, 0)]
    assert clustered(spark, [(7, [1.0])], 8, 2, 2) == ([], [])
    grid = [(i, [float(i % 5), float(i // 5 % 5)]) for i in range(125)]
    assert clustered(spark, grid, 7, 8, 2, scale=1)[0] == lloyd(grid, 7, 8, 1)[0]


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 9, 12]) for _ in range(3)]) for i in range(60)]
    expected, points = lloyd(rows, 5, 3, 1024)
    got, centroids = clustered(spark, rows, 5, 3, 3)
    assert got == [(i, c, d if d < 1 << 63 else None) for i, c, d in expected]
    assert [[int(x) for x in r["centroid"]] for r in centroids] == points


def test_unusable_vectors_are_left_out(spark):
    good = [(i, [float(i % 4), 1.0], 1) for i in range(12)]
    bad = [(20, None, 1), (21, [1.0], 1), (22, [1.0, None], 1), (23, [float("nan"), 1.0], 1), (24, [float("inf"), 1.0], 1), (25, [], 1)]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, cluster int")
    report = shallot.clustering_report(*shallot.cluster_vectors(table, k=3, rounds=2, dim=2)).collect()
    assert sorted(r["vec_id"] for r in report) == list(range(12))
    assert {r["inertia"] for r in report} == {sum(r["distance"] for r in report)}
    for r in report:
        assert r["cluster_inertia"] == sum(x["distance"] for x in report if x["cluster"] == r["cluster"])


# --- hard negatives ------------------------------------------------------------------

def mined(rows, scale=256, every=100, k=5, n=10):
    """(anchor, positive, rank, negative, scores) by comparing all."""
    exact = {(i, y, tuple(int(np.floor(scale * x)) for x in v)) for i, v, y in rows}
    found = []
    for i, y, v in sorted(exact):
        if i % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in exact if j != i and len(w) == len(v)]
            for s, p, _ in sorted(r for r in scored if r[2] == y)[:k]:
                window = sorted((t, j) for t, j, z in scored if z != y and 30 * -s <= 100 * -t <= 90 * -s)[:n]
                found += [(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(window, 1)]
    return sorted(found)


def negatives_of(table, **how):
    rows = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, **how).collect()
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows)


def test_scores_are_inner_products():
    rng = np.random.default_rng(9)
    for dim, size in ((1, 3), (8, 1), (13, 300), (64, 256), (70, 1 << 30)):
        a, b = rng.integers(-size, size + 1, (4, dim)), rng.integers(-size, size + 1, (50, dim))
        planes = negatives.bit_planes(b)
        assert (negatives.scores(negatives.subset_sums(a), planes) == a @ b.T).all()
    assert len(negatives.bit_planes(np.zeros((3, 8), np.int64))) == 1
    assert len(negatives.bit_planes(np.full((3, 8), -1))) == 1 and len(negatives.bit_planes(np.full((3, 8), 255))) == 9


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    rows = [(int(i), (rng.normal(size=12) * 0.5).round(3).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(i, rows[300][1], i % 4) for i in range(700, 1000)]  # copies: many ties
    rows += [rows[3], (400, rows[9][1], 1), (1100, [1.0, 2.0], 0), (1101, [1.0, 1.0], 0), (1102, [0.5, 0.5], 1), (1200, [1.0], 0)]
    table = spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], VECTORS).repartition(4)
    expected = mined(rows)
    assert len(expected) > 200 and negatives_of(table, segment_rows=90, block_rows=4) == expected
    assert negatives_of(table) == expected  # the sizes of segments and blocks change nothing


def test_rows_that_take_no_part(spark):
    good = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2), (3, [0.9, 0.8], 2)]
    bad = [(None, [1.0, 1.0], 1), (4, None, 1), (5, [1.0, 1.0], None), (6, [1.0, None], 1), (8, [float("inf"), 1.0], 2)]
    table = spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in good + bad], VECTORS)
    assert negatives_of(table) == mined(good) != []
    assert negatives_of(table.limit(0)) == []
    assert negatives_of(table.where("vec_id = 0")) == []
    # Zero vectors score nothing; every score of 0 is in the window of 0.
    zeros = [(0, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.0], 2)]
    assert negatives_of(spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in zeros], VECTORS)) == mined(zeros) != []


def test_relabelling(spark):
    rows = [(i, [1.0 + i / 50, 1.0], 9) for i in range(15)]
    table = spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], VECTORS)
    expected = mined([(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows])
    assert negatives_of(table, relabel=negatives.shifted_labels()) == expected
