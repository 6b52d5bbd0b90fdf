"""Near-duplicates, shards, neighbours, chat, mixing, packing and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlens.llm import ann, chat, html, mixing, neardup, oracle, packing, queries, sharding
from tests.compare import connect, difference
from tests.conftest import MEDIUM, SMALL
from tests.llm.test_text_operators import AWKWARD


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "s", "clash", 7) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size int")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_matches_sql(spark, name, folder):
    assert difference(queries.QUERIES[name](spark, folder), connect(folder), oracle.ORACLE[name]) is None


# --- near-duplicates -----------------------------------------------------------------

def shingles(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_components(rows, width=3, percent=85):
    """Smallest id reachable per row, comparing all pairs of different sets."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_components_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):  # chains and stars of near copies around the threshold, and exact copies
        base = rng.choices(vocabulary, k=rng.choice([30, 80, 200]))
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 18))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
            base = words if rng.random() < 0.5 else base
    rows += [(n + k, t) for k, t in enumerate(["Same Text here", "same text HERE", "one", "One", "two words", None, "", " ", "ÀÉ à", "àé à"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_pairs_under_the_distance_share_a_key():
    rng = np.random.default_rng(2)
    for distance in range(neardup.CHUNKS * (neardup.ERRORS + 1)):
        a = rng.integers(0, 1 << neardup.BITS, (50, neardup.POSITIONS))
        b = a.copy()
        for row in b:
            at = rng.choice(neardup.POSITIONS, distance, replace=False)
            row[at] = (row[at] + 1 + rng.integers(0, 1000, distance)) % (1 << neardup.BITS)
        keys = neardup.chunk_keys(np.stack([a, b]).reshape(-1, neardup.POSITIONS).astype(np.int32)).reshape(2, 50, -1)
        assert (keys[0] == keys[1]).any(axis=1).all(), distance


def test_signatures_estimate_similarity():
    text = " ".join(f"w{i}" for i in range(20_000))
    other = " ".join(f"w{i}" for i in range(1_000, 20_000))
    a, b = neardup.shingle_hashes(text), neardup.shingle_hashes(other)
    assert len(a) == 19_998 and len(np.intersect1d(a, b)) == 18_998
    assert (neardup.signature(a) == neardup.signature(b)).mean() > 0.8


def test_near_duplicates_of_awkward_rows(spark, awkward):
    rows = neardup.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by_id[1] == [(0, 1, True)] and by_id[2] == [(0, 2, True)] and by_id[4] == [(1, 4, True)] * 2
    assert by_id[5] == [(1, 5, True)] and by_id[6] == [(1, 6, True)] and by_id[None] == [(5 - 1, None, True)]
    assert neardup.near_duplicates(awkward.limit(0)).collect() == []


def test_a_large_group_costs_few_pairs(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = neardup.near_duplicates(docs).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def bucket_rows(spark, n, parts):
    """One bucket of near copies that are still ``parts`` components, and what comparing it needs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"x{i}" if j == rng.randrange(200) else w for j, w in enumerate(base)) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {i: len(neardup.shingle_hashes(t)) for i, t in enumerate(texts)}
    classes = spark.createDataFrame([(i, sizes[i]) for i in range(n)], "class long, n_shingles long")
    sets = spark.createDataFrame([(i, neardup.shingle_hashes(t).view("int64").tolist()) for i, t in enumerate(texts)],
                                 "class long, shingles array<long>")
    members = spark.createDataFrame([(7, i) for i in range(n)], "key long, class long")
    groups = spark.createDataFrame([(i, i % parts) for i in range(n)], "class long, component long")
    return docs, classes, sets, members, groups


@pytest.mark.parametrize("exact", [False, True])
def test_a_bucket_gives_fewer_rows_than_components(spark, exact):
    _, classes, sets, members, groups = bucket_rows(spark, 400, 100)
    split = neardup._split_buckets(members, groups, classes)
    rows = neardup._cross_links(split, classes, sets, exact=exact).collect()
    assert len(rows) == 99
    pairs = neardup._pivot_pairs(members, groups, spark.createDataFrame([], "a long, b long")).count()
    assert pairs <= 400


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    _, classes, sets, members, groups = bucket_rows(spark, 120, 60)
    split = neardup._split_buckets(members, groups, classes)
    assert split.first()["blocks"] == 8
    within = neardup._cross_links(split, classes, sets).collect()
    across = neardup._cross_links(split, classes, sets, exact=True).collect()
    assert len(within) < 120 and 59 <= len(across) <= 59 * 8
    links = spark.createDataFrame([(r["a"], r["b"]) for r in across] + [(i, i % 60) for i in range(60, 120)], "a long, b long")
    assert {r["component"] for r in neardup.components(links).collect()} == {0}


def test_shortened_shingles_never_decide(spark, monkeypatch):
    """Where 16 bits make everything look linked, the exact comparison still finds the true components."""
    monkeypatch.setattr(neardup, "PIVOT_ROUNDS", 0)
    rng, rows = random.Random(12), []
    common = [f"c{i}" for i in range(900)]
    for i in range(60):  # chains of neighbours around the threshold that share many keys
        words = list(common)
        for _ in range(rng.randrange(20, 60)):
            words[rng.randrange(900)] = f"u{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_width_and_share_can_be_set(spark):
    words = [f"w{i}" for i in range(2000)]
    appended = words[:200] + [f"x{i}" for i in range(44)]  # 0.82 on three and on five words
    scattered = [f"y{i}" if i % 40 == 20 else w for i, w in enumerate(words[1000:1400])]  # 0.86 on three words, 0.77 on five
    rows = [(0, words[:200]), (1, appended), (2, words[1000:1400]), (3, scattered)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    found = lambda **rule: {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, **rule).collect()}
    assert found(percent=80, width=5) == {0: 0, 1: 0, 2: 2, 3: 3} and found() == {0: 0, 1: 1, 2: 2, 3: 2}
    assert (neardup.max_distance(85), neardup.max_distance(80)) == (19, 22)


# --- packing of awkward texts: see below -------------------------------------------------

@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 300_000, "word" + " " * 400_000 + "x", " \t" * 100_000 + "end"])
def test_very_long_white_space_is_encoded_as_by_the_file(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("length", [19_999, 20_000, 20_001])
def test_both_encoders_agree_at_the_length_that_parts_them(length):
    from tokenizers import Tokenizer
    import public_tokenizers
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * length, "a" + "\n" * length + "b c"):
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_no_class_nor_key_is_broadcast(spark):
    """Files of the classes are small against their rows, so Spark would take keys and signatures for small tables."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 30), n -> string(id * 31 + n))) AS text")
    classes = neardup.stored(neardup.sketches(docs, "doc_id", "text").selectExpr(
        "print", "doc_id AS first_id", "n_shingles", "signature", "doc_id AS class"), "classes")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    members = neardup._members(classes)
    members.collect()
    assert "Broadcast" not in plan(members) and "SortMergeJoin" in plan(members)

    many = neardup.stored(spark.range(neardup.FEW_PAIRS + 1).selectExpr("id % 20 AS a", "20 + id % 380 AS b"), "tested")
    close = neardup._close(many, classes)
    assert close.count() == 0
    assert "Broadcast" not in plan(close)
    few = neardup._close(many.limit(50), classes)
    assert "BuildLeft" in plan(few) and "BuildRight" not in plan(few)


# --- shards ----------------------------------------------------------------------------

def test_small_shards_equal_sql(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    for limit in (40_000, 3_000_000):
        assert difference(sharding.extendible_shards(docs, limit=limit), connect(MEDIUM), oracle.shards_sql(limit)) is None
    table = sharding.directory(sharding.extendible_shards(docs, limit=40_000)).collect()
    assert all(r["shard_bytes"] <= 40_000 or r["shard_rows"] == 1 for r in table)
    assert sum(2.0 ** -r["depth"] for r in table) <= 1  # prefix-free


def test_repeated_keys_split_by_row(spark, awkward):
    docs = spark.createDataFrame([(1, "x" * 10)] * 500 + [(None, "y" * 10)] * 100, "doc_id long, text string").repartition(3)
    shards = sharding.extendible_shards(docs, limit=100).collect()
    assert len(shards) == 600 and all(r["shard_bytes"] <= 100 for r in shards)
    assert Counter(r["doc_id"] for r in shards) == {1: 500, None: 100}
    rows = sharding.extendible_shards(awkward, limit=1000).collect()
    assert len(rows) == len(AWKWARD) and all(r["shard_bytes"] <= 1000 or r["shard_rows"] == 1 for r in rows)
    assert sharding.extendible_shards(awkward.limit(0)).collect() == []


# --- neighbours --------------------------------------------------------------------------

def brute_neighbours(rows, k=5):
    """Exact answer for ids divisible by 50, ties to smaller ids."""
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v)
            and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            near = [(-(w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = [j for _, j in sorted(near)[:k]]
    return out


def test_recall_over_the_whole_table(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()]
    found = defaultdict(list)
    for r in sorted(queries.op7_permutation_index(spark, MEDIUM).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    exact = brute_neighbours(table)
    assert set(found) == set(exact) and all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(exact[q])) for q in exact) >= 0.9 * 5 * len(exact)


def test_recall_when_few_candidates_are_reranked(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = defaultdict(set)
    for r in ann.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, segment_rows=1000, query_rows=20, candidates=100).collect():
        found[r["query_id"]].add(r["vec_id"])
    exact = brute_neighbours(rows)
    assert sum(len(found[q] & set(exact[q])) for q in exact) >= 0.9 * 5 * len(exact)


def test_neighbours_of_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (4, None), (5, []),
            (6, [0.0, 0.0]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (100, [1.0, 1.0, 1.0]),
            (10, [-1.0, 0.0]), (11, [1.0, 0.0]), (12, [1.0, 0.0]), (13, [1.0, 0.0]), (14, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("class", F.lit("clash"))
    got = defaultdict(list)
    for r in sorted(ann.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert [v for v, _ in got[0]] == [1, 2, 11, 12, 13] and [v for v, _ in got[50]] == [0, 1, 2, 11, 12]
    assert {s for _, s in got[0]} == {1.0} and 100 not in got
    assert ann.nearest_neighbours(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []


# --- chat ----------------------------------------------------------------------------------

def test_rendering_and_reading_back_are_inverse():
    rng = random.Random(9)
    pieces = ["\\", "#", "<", ":", "\n", "### user: ", "</turn>\n", "\\h", "\\\\", "é𝕏", " ", "ok"]
    render = chat.compile_template()
    for _ in range(500):
        turns = [{"role": "".join(rng.choices(pieces, k=rng.randrange(3))) if rng.random() < 0.3 else rng.choice(["user", "assistant", "system"]),
                  "text": "".join(rng.choices(pieces, k=rng.randrange(12)))} for _ in range(rng.randrange(5))]
        text, spans = render(turns)
        assert chat.read_back(text) == [(t["role"], t["text"]) for t in turns]
        assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t["text"] for t in turns if t["role"] == "assistant")
        assert len(re.findall("</turn>", text)) == len(turns) == len(re.findall("###", text))


def test_template_language():
    render = chat.compile_template("{% set n = 'a' ~ 'b' %}{{ n | upper }}{% for m in messages %}{% if loop.first %}[{% elif m.role == 'x' and not loop.last %}"
                                   "x{% else %}-{% endif %}{{ m['text'] | trim }}{% if loop.last %}]{% endif %}{% endfor %}{{ 1 + 2 }}{{ none }}")
    assert render([{"role": "u", "text": " 1 "}, {"role": "x", "text": "2"}, {"role": "x", "text": "3"}])[0] == "AB[1x2-3]3"
    folded = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}never{% else %}d{% endif %}"))
    assert folded == (chat.Output(chat.Const("abcd")),) or "".join(chat._text(n.value.value) for n in folded) == "abcd"
    for bad in ("{% for x in other %}{% endfor %}", "{% if %}x{% endif %}", "{{ a.b( }}", "{{ x | os }}", "{% import os %}", "{% if a %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.compile_template("{{ messages.__class__ }}{% for m in messages %}{{ m.__class__ }}{% endfor %}")([{"role": "a", "text": "b"}])[0] == ""


def test_chat_with_awkward_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, None, "user", "first"), (1, 1, "assistant", None), (None, 0, "assistant", "lone"),
            (2, 0, "assistant", "x" * 200_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[None]["loss_chars"], got[2]["loss_chars"]) == (4, 0, 4, 200_000)
    text = chat.format_conversations(turns.where("conv_id = 1")).first()["formatted"]
    assert chat.read_back(text) == [("user", "first"), ("", "hi"), ("assistant", ""), ("assistant", "")]
    assert chat.format_conversations(turns.limit(0)).collect() == []


# --- mixing --------------------------------------------------------------------------------

def water_fill(sizes):
    """Targets by repeated resharing of the excess, source names in order."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, target, left = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, float(sum(sizes.values()))
    free = list(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if 3 * sizes[s] < unit * weight[s]]
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets_and_totals(spark):
    rng = random.Random(8)
    sources = ["b", "a", None, "ä", "Z", "tiny"]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(sources[:5])) for i in range(900)]
    rows += [(1000, "just a few words", "tiny"), (1001, None, "zero"), (1002, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_sources(docs).collect()
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    wanted = water_fill(sizes)
    for r in got:
        assert r["target"] == pytest.approx(wanted[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in wanted)
    again = {tuple(r) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert {tuple(r) for r in got} == again


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "word " * 40 + ("" if i % 2 else "# * $ % " * 10), "a" if i < 2000 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # Source a has a third of the weight for about half of the words: a fraction of it is drawn.
    picked = [r["doc_id"] for r in mixing.mix_sources(docs).where("taken > 0").collect() if r["doc_id"] < 2000]
    good = sum(i % 2 for i in picked) / 1000
    assert good > 1.2 * (len(picked) - 1000 * good) / 1000


def test_mixed_rows_follow_what_is_taken(spark, awkward):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    taken = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    words = Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixing.mixed_documents(docs).collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        words[r["doc_id"]] += n
        assert r["text"] == texts[r["doc_id"]] or n < taken[r["doc_id"]]["size"]
    assert words == Counter({i: r["taken"] for i, r in taken.items() if r["taken"]})
    assert len(mixing.mix_sources(awkward.select("doc_id", "text", "source", "key")).collect()) == len(AWKWARD)
    assert mixing.mix_sources(awkward.select("doc_id", "text", "source").limit(0)).collect() == []
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


# --- packing -------------------------------------------------------------------------------

def check_packing(rows, texts, capacity=packing.CAPACITY):
    """Round trip: pieces give back every document's ids, sequences are gapless and within the capacity."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    from public_tokenizers import path
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(pieces[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["length"] == capacity or n == 0
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(sequences)


def test_packing_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op10_best_fit_packing(spark, SMALL).collect()
    used = check_packing(rows, texts)
    lengths = [r["length"] for r in rows]
    large = sum(n > packing.CAPACITY // 2 for n in lengths)
    assert used <= 1.02 * max(large, math.ceil(sum(lengths) / packing.CAPACITY)) + 1


def test_rounds_of_packing_come_close_to_one(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    one = packing.pack_documents(docs).select("sequence_id").distinct().count()
    rows = packing.pack_documents(docs, items_per_task=100).collect()
    assert len({r["sequence_id"] for r in rows}) <= 1.05 * one
    assert len(rows) == packing.token_pieces(docs).count()


def test_best_fit():
    bins = packing.best_fit(np.array([6, 5, 5, 4, 3, 1]), 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 3
    assert [sorted(b) for b in bins[:2]] == [[0, 3], [1, 2]]
    assert packing.piece_bounds(5000, 2048) == [(0, 904), (904, 2952), (2952, 5000)] and packing.piece_bounds(2048) == [(0, 2048)]


def test_encoders_agree():
    from public_tokenizers import path
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(12)
    texts = ["", "a", "<|endoftext|> in a text", "x<|endoftext|>", "<|endoftext", "don't I'LL we've", "   \n\n\t  x  ", "é漢字🙂​﻿", "0123456789" * 30]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x3000, 0xA000), 0x1F600, 10, 32])) for _ in range(200))
              for _ in range(200)]
    for text in texts:
        assert packing.token_ids(text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_packing_of_awkward_rows(spark, awkward):
    rows = packing.pack_documents(awkward).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2)) == 2
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack_documents(awkward.limit(0)).collect() == []


# --- pipeline ------------------------------------------------------------------------------

def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at = docs
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SMALL).cache()
        sizes[name] = at.count()
        if name != "best_fit_packing":
            assert at.columns == docs.columns and [f.dataType for f in at.schema] == [f.dataType for f in docs.schema]
        if name == "near_duplicates":
            expected = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], width=5, percent=80)
            assert {r["doc_id"] for r in at.collect()} == {c for _, c in expected.values()}
            kept = sizes[name]
        if name == "secret_scan":
            from tests.llm.test_text_operators import plain_spans
            assert sizes[name] == kept and all(plain_spans(r["text"]) == "" for r in at.collect())
    assert sizes["language_id"] == docs.count()
    assert corpus_pipeline.run(spark, SMALL).count() == sizes["best_fit_packing"]


HELPERS = ("_key _id _text _source _size _taken _part _print _from _found _host _page _templates score lang_pred rejected spans size taken "
           "target source_size class component key print signature n_shingles kept component_id rank").split()


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those the operators use inside, and one of a type without an order."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5)).withColumns({c: F.lit(f"{c} of the user") for c in HELPERS}).withColumn(
        "attributes", F.create_map(F.lit("a"), F.lit(1)))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SMALL).cache()
        assert at.columns == docs.columns and at.count() > 20, name
        for row in at.collect():
            assert all(row[c] == f"{c} of the user" for c in HELPERS) and row["attributes"] == {"a": 1}, name
    assert corpus_pipeline.STAGES[-1][1](spark, at, SMALL).count() >= at.count()
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(20)
    marked = pages.withColumns({c: F.lit(f"{c} of the user") for c in HELPERS})
    assert {tuple(r[c] for c in HELPERS) for r in html.extract_main_text(marked).collect()} == {tuple(f"{c} of the user" for c in HELPERS)}


def test_one_row_per_group_and_per_text(spark):
    sentence = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, sentence("a"), "s"), (1, sentence("a"), "r"), (1, sentence("a"), "s"),  # a repeated row, once from another source
            (0, sentence("b"), "s"), (2, sentence("b"), "s"), (2, sentence("c"), "s"),  # id 2: a copy of 0, and a text of its own
            (None, sentence("d"), "s"), (None, sentence("d"), "s"), (None, sentence("a"), "s"), (None, sentence("e"), "s"),
            (8, None, "s"), (None, "", "s"), (None, "", "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r["doc_id"], (r["text"] or "")[:1], r["source"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect())
    assert got == Counter({(1, "a", "r"): 1, (0, "b", "s"): 1, (2, "c", "s"): 1, (None, "d", "s"): 1, (None, "e", "s"): 1,
                           (8, "", "s"): 1, (None, "", "s"): 2})


def test_the_mix_tells_texts_of_one_id_and_size_apart(spark):
    rows = [(None, " ".join(f"{s}{i}w{j}" for j in range(10)), s) for s in ("s", "r") for i in range(20)] + [(None, "same for both", s) for s in "rs"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert words == {t["source"]: round(t["target"]) for t in mixing.source_targets(
        mixing.sized_rows(docs, "doc_id", "text", "source")).collect()}


def test_packing_in_many_small_tasks_goes_on_to_one(spark):
    """Full pieces aside, no two bins fit together at the end, and hardly more bins are made than the tokens need."""
    rng = np.random.default_rng(14)
    fills = np.concatenate([rng.integers(1, 2048, 3000), np.full(2000, 700), rng.integers(1, 60, 1500)]).tolist()
    member = "array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"
    items = spark.createDataFrame([(f, [(i, 0, 0, f, 0, 0)]) for i, f in enumerate(fills)], f"fill long, members {member}").repartition(8)
    bins = packing.pack(items, items_per_task=100).collect()
    assert sorted(m["doc_id"] for b in bins for m in b["members"]) == list(range(len(fills)))
    for b in bins:
        assert b["fill"] <= 2048 and np.cumsum([0] + [m["length"] for m in b["members"]])[:-1].tolist() == [m["offset"] for m in b["members"]]
    rounds = len(packing.best_fit(np.array(fills)))
    assert len(bins) <= 1.02 * rounds, (len(bins), rounds, sum(fills) / 2048)
