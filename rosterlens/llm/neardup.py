"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's signature has ``CHUNKS`` x ``ROWS`` positions of ``BITS`` bits.
Two documents of similarity J differ in about (1 - J) of the positions.  The
signature is split into chunks; two signatures that differ in fewer than
``CHUNKS * (ERRORS + 1)`` positions agree, by pigeonhole, in at least one chunk
up to ``ERRORS`` positions.  Every choice of ``ERRORS`` positions of a chunk is
left out once, so such a pair shares at least one key: none under that distance
is lost.  With 8 chunks of 4 positions and one error that is a distance of 15
of 32; a pair with J = 0.85 shares no key with probability 2e-8, one with
J = 0.8 with probability 1.2e-6.

Keys only propose.  Every proposed pair is confirmed on the full shingle sets.

How large groups are handled.  Documents with equal shingle sets form one class
and are one row from then on.  In each key's bucket the members are compared
with one pivot: first the smallest member, then, in buckets that still hold
several components, the member with the most links so far.  That joins a group
of g near copies by about g pairs.  What is left are classes that share a
bucket with a component they may not belong to.  For these, members outside a
bucket's largest component are compared with the bucket's other members, block
by block in tasks, through an inverted file of 16 bits of every shingle.  That
bounds the intersection from above.  A pair that may be linked joins the two
components for the rest of the block, so a block proposes fewer pairs than it
has components, whatever its size.  Proposals are confirmed like all others.
Buckets in which one was refuted, or that have several blocks, are compared once
more by whole shingles, block against block, as far as they still hold several
components.  Every pair that shares a key is thus confirmed, refuted, or inside
one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.shared import free_names, stored

WIDTH = 3  # words in a shingle
PERCENT = 85  # linked when 100 * intersection >= PERCENT * union
CHUNKS, ROWS, ERRORS, BITS = 8, 4, 1, 16
POSITIONS = CHUNKS * ROWS
UNREAD = 2e-9  # pairs at the threshold that are dropped unread, because their signatures differ in too many positions
PIVOT_ROUNDS = 2  # rounds with the best linked member of a bucket as its pivot
BLOCK, VOLUME = 4096, 1 << 22  # members of a bucket, and their shingles, that one task compares others with
SLICE = 4096  # shingles hashed at once
FEW_PAIRS = 20_000  # pairs that are sent to every executor when their classes are looked up


def max_distance(percent: int = PERCENT) -> int:
    """Positions in which signatures of linked sets may differ, but for a share of ``UNREAD``: 19 at 85, 22 at 80."""
    apart, beyond = 1 - percent / 100, 0.0
    for n in range(POSITIONS, 0, -1):
        beyond += math.comb(POSITIONS, n) * apart**n * (1 - apart) ** (POSITIONS - n)
        if beyond > UNREAD:
            return n
    return 0


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _random(start: int, count: int) -> np.ndarray:
    return mix(np.arange(start, start + count, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(0x9E3779B97F4A7C15))


_SEEDS, _ODD = _random(1 << 40, POSITIONS), _random(1 << 41, POSITIONS) | U(1)
_PLACE = _random(1 << 42, 16) | U(1)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, A-Z folded; empty without a word."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    weights = _random(0, int(lengths.max()))
    words = mix(np.add.reduceat((_FOLD[raw[inside]] + U(1)) * weights[place], offsets) + lengths.astype(np.uint64))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        total = total + words[i:len(words) - span + 1 + i] * _PLACE[i]
    return np.unique(mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """``POSITIONS`` values of ``BITS`` bits: the low bits of the smallest hash under each function."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SLICE):
        part = shingles[at:at + SLICE, None]
        least = np.minimum(least, ((part ^ _SEEDS) * _ODD).min(axis=0))
    return (mix(least) & U((1 << BITS) - 1)).astype(np.int32)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * ROWS) keys: each chunk with each one of its positions left out."""
    chunks = signatures.astype(np.uint64).reshape(len(signatures), CHUNKS, ROWS)
    keys = np.zeros((len(signatures), CHUNKS, ROWS), np.uint64)
    for left_out in range(ROWS):
        for place in range(ROWS):
            if place != left_out:
                keys[:, :, left_out] = keys[:, :, left_out] << U(BITS) | chunks[:, :, place]
    tags = _random(1 << 43, CHUNKS * ROWS).reshape(CHUNKS, ROWS)
    return mix(keys ^ tags).reshape(len(signatures), CHUNKS * ROWS).view(np.int64)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def sketches(docs: DataFrame, id_column: str, text: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, print, signature) of every row; print and signature are null for empty sets."""
    id_type = docs.schema[id_column].dataType
    kept = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, made = [], [], []
            for value in batch.column("text"):
                shingles = shingle_hashes(value.as_py(), width)
                sizes.append(len(shingles))
                prints.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                made.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(made, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "print", "signature"])

    return kept.mapInArrow(sketch, _schema(("doc_id", id_type), ("n_shingles", T.LongType()), ("print", T.BinaryType()),
                                           ("signature", T.ArrayType(T.IntegerType()))))


def _keys_of(classes: DataFrame) -> DataFrame:
    """(key, class): every chunk key of every class."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("signature").flatten().to_numpy()
                made = chunk_keys(flat.reshape(batch.num_rows, POSITIONS))
                owners = np.repeat(batch.column("class").to_numpy(), CHUNKS * ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(made.reshape(-1)), pa.array(owners)], ["key", "class"])

    return classes.select("class", "signature").mapInArrow(keys, _schema(("key", T.LongType()), ("class", T.LongType())))


def _members(classes: DataFrame) -> DataFrame:
    """(key, class, pivot) of every bucket with several classes; the pivot is the smallest class.

    Spark takes the keys for a table as small as the file of the classes, though
    there are ``CHUNKS * ROWS`` of them a class, and would send them all through
    the driver; so the join is told to sort.
    """
    keys = _keys_of(classes)
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("pivot")).where("n > 1")
    return keys.hint("merge").join(buckets.select("key", "pivot"), "key")


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)


def _close(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures do not rule out a link.

    Spark counts an array as one number, so it takes the classes for a fraction
    of their size; they are never broadcast here, a few pairs are.
    """
    side = lambda name: classes.select(F.col("class").alias(name), F.col("n_shingles").alias(f"n_{name}"),
                                       F.col("signature").alias(f"s_{name}"))
    how = "broadcast" if pairs.count() <= FEW_PAIRS else "merge"
    return pairs.hint(how).join(side("a"), "a").hint(how).join(side("b"), "b").where(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (_distance(F.col("s_a"), F.col("s_b")) <= max_distance(percent))
    ).select("a", "b", "n_a", "n_b")


def class_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str, text: str,
               width: int = WIDTH) -> DataFrame:
    """(class, shingles) of the classes in ``wanted``, stored.

    Only texts with one of their ids are read again, one per class: by the
    class's smallest id, then by the print of the set itself.
    """
    wanted = wanted.select("class").distinct().join(classes, "class").select("class", "print", "first_id")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(value.as_py(), width) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["print", "shingles"])

    ids = wanted.select(F.col("first_id").alias("_id")).distinct()
    texts = docs.select(F.col(id_column).alias("_doc"), F.col(text).alias("text")).join(
        ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("text")
    found = texts.mapInArrow(full, _schema(("print", T.BinaryType()), ("shingles", T.ArrayType(T.LongType()))))
    return stored(wanted.select("class", "print").join(found, "print").dropDuplicates(["class"]).select("class", "shingles"), "sets")


def confirmed(close: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of classes that are linked by their full shingle sets."""
    both = close.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", "n_a", "n_b", shared.alias("shared")).where(
        100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(class, component): the smallest class reachable over the edges (a, b), for each class with an edge.

    Alternates large and small stars until nothing changes; the number of
    rounds grows with the logarithm of the longest path.  Each round is a
    grouped minimum and a join back on the node.
    """
    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(frame: DataFrame, large: bool) -> DataFrame:
        reverse = frame.select(F.col("b").alias("a"), F.col("a").alias("b"))
        near = frame.unionByName(reverse) if large else frame.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        moved = near.join(least, "a")
        if large:
            moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
                least.select("a", F.col("low").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = mark(current)
    while before[0]:
        current = stored(star(star(current, True), False), "stars")
        after = mark(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("class"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("class"), F.col("b").alias("component"))).distinct()


def _placed(members: DataFrame, groups: DataFrame) -> DataFrame:
    return members.select("key", "class").join(groups, "class", "left").select(
        "key", "class", F.coalesce("component", "class").alias("component"))


def _pivot_pairs(members: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's best linked member with the members of other components."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("degree"))
    placed = stored(_placed(members, groups), "placed")
    ranked = placed.join(degrees, "class", "left").withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)), -F.col("class")))
    pivots = ranked.groupBy("key").agg(F.max_by(F.struct("class", "component"), "rank").alias("pivot"),
                                       F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return placed.join(pivots.select("key", "pivot"), "key").where(F.col("component") != F.col("pivot.component")).select(
        F.least("class", "pivot.class").alias("a"), F.greatest("class", "pivot.class").alias("b")).distinct()


def _split_buckets(members: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, class, component, largest, blocks) of the members of buckets that hold several components.

    A bucket is cut into blocks of about ``BLOCK`` members and ``VOLUME`` shingles.
    """
    placed = _placed(members, groups).join(classes.select("class", "n_shingles"), "class")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("volume"))
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("volume") / VOLUME)).cast("int")
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"),
                                       F.count(F.lit(1)).alias("several"), blocks.alias("blocks")).where("several > 1")
    return stored(placed.drop("n_shingles").join(largest.select("key", "largest", "blocks"), "key"), "split")


class _Bucket:
    """The rows of one block of a bucket: held members, and members that ask for links to them."""

    def __init__(self, percent: int):
        self.percent, self.held, self.asking = percent, [], []
        self.roots: dict[int, int] = {}  # components that a link has joined, to one of them

    def root(self, component: int) -> int:
        while (above := self.roots.get(component, component)) != component:
            self.roots[component] = self.roots.get(above, above)
            component = above
        return component

    def links(self) -> list[tuple[int, int]]:
        """(asker, member) rows that join two components each; forgets the askers.

        A member of the asker's own component, as joined so far, is not looked
        at, so there are fewer rows than components.
        """
        found: list[tuple[int, int]] = []
        if self.asking and self.held:
            names, sizes = (np.array([row[i] for row in self.held]) for i in (0, 2))
            roots = np.array([self.root(row[1]) for row in self.held])
            lengths = np.array([len(row[3]) for row in self.held])
            values = np.concatenate([row[3] for row in self.held])
            order = np.argsort(values, kind="stable")
            values, owners = values[order], np.repeat(np.arange(len(lengths)), lengths)[order]
            for name, component, size, own in self.asking:
                if (roots == self.root(component)).all():
                    continue
                first, last = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
                counts = last - first
                hits = np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)
                # A shortened value may stand for several shingles of a set, so those count as shared.
                shared = np.bincount(owners[hits], minlength=len(lengths)) + np.minimum(size - len(own), sizes - lengths)
                mine = self.root(component)
                near = np.flatnonzero((roots != mine) & (100 * shared >= self.percent * (size + sizes - shared)))
                while len(near):
                    found.append((name, int(names[near[0]])))
                    joined = int(roots[near[0]])
                    self.roots[joined] = mine
                    roots[roots == joined] = mine
                    near = near[roots[near] != mine]
        self.asking = []
        return found


def _cross_links(split: DataFrame, classes: DataFrame, sets: DataFrame, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """(key, a, b): for each block of a bucket, pairs that share the key and join its components.

    Members outside a bucket's largest component ask, all members are held.
    Without ``exact`` members are compared with those of their own block by 16
    bits of every shingle, so the pairs may be linked; with it the askers go to
    every block of their bucket, whole shingles are compared, and the pairs are.
    """
    short = F.array_distinct(F.transform("shingles", lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short")))
    test = classes.select("class", "n_shingles").join(sets.select("class", (F.col("shingles") if exact else short).alias("values")), "class")
    blocks = F.col("blocks")
    place = lambda block, holds, asks: F.struct(block.alias("block"), holds.alias("holds"), asks.alias("asks"))
    outside, true, false = F.col("component") != F.col("largest"), F.lit(True), F.lit(False)
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    everywhere = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: place(b, b == own, true))
    places = F.when(outside, everywhere).otherwise(F.array(place(own, true, false))) if exact else F.array(place(own, true, outside))
    # Joined before they are exploded: Spark would take the exploded rows for a table of the size before.
    rows = split.join(test, "class").select("key", "class", "component", "n_shingles", "values", F.explode(places).alias("at")).select(
        "key", "at.block", "at.holds", "at.asks", "class", "component", "n_shingles", "values")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(key: int, found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if found:
                both = np.sort(np.array(found, np.int64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), key, np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                                 ["key", "a", "b"])

        current, bucket = (None, None), _Bucket(percent)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "block", "holds", "asks", "class", "component", "n_shingles")]
            for key, block, holds, asks, name, component, size, values in zip(*columns, batch.column("values")):
                if (key, block) != current:
                    yield from answer(current[0], bucket.links())
                    current, bucket = (key, block), _Bucket(percent)
                row = (name, component, size, values.values.to_numpy())
                if holds:
                    bucket.held.append(row)
                if asks:
                    bucket.asking.append(row)
                if not holds and len(bucket.asking) >= BLOCK:  # held members come first, so the block is complete
                    yield from answer(key, bucket.links())
        yield from answer(current[0], bucket.links())

    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("holds"))
    return dealt.mapInArrow(compare, _schema(("key", T.LongType()), ("a", T.LongType()), ("b", T.LongType())))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Linked are rows whose sets of ``width``-word shingles have a similarity of
    ``percent`` or more.

    Null, empty and wordless texts have no shingle and are linked with nothing:
    their component is their own id.  Repeated rows stay; rows with one id and
    different texts are told apart by their texts.  A null id is never the
    component of others and its row is kept only if its component has no id.
    Long texts are hashed whole, in slices.  Other columns do not take part.
    An empty table gives an empty result.
    """
    sketched = stored(sketches(docs, id_column, text, width), "sketches")
    filled = sketched.where(F.col("n_shingles") > 0)
    # One row per distinct shingle set, numbered in the stored table.
    classes = stored(filled.groupBy("print").agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")
    ).withColumn("class", F.monotonically_increasing_id()), "classes")

    members = stored(_members(classes), "members")

    def linked(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        close = stored(_close(pairs, classes, percent), "close")
        if sets is None:
            sets = class_sets(close.select(F.explode(F.array("a", "b")).alias("class")), classes, docs, id_column, text, width)
        return stored(confirmed(close, sets, percent), "links")

    tested = stored(members.where("class <> pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct(), "tested")
    links = linked(tested)
    groups = stored(components(links), "groups")
    for _ in range(PIVOT_ROUNDS):
        pairs = stored(_pivot_pairs(members, groups, links).join(tested, ["a", "b"], "left_anti"), "tested")
        more = linked(pairs)
        tested, links = tested.unionByName(pairs), links.unionByName(more)
        if more.isEmpty():
            break
        groups = stored(components(links), "groups")
    undecided = _split_buckets(members, groups, classes)
    sets = class_sets(undecided, classes, docs, id_column, text, width)
    proposed = stored(_cross_links(undecided, classes, sets, percent), "proposed")
    more = linked(proposed.select("a", "b").distinct(), sets)
    if not more.isEmpty():
        links = links.unionByName(more)
        groups = stored(components(links), "groups")
    # A refuted proposal may have stood in for others, and blocks have not met: such buckets are compared exactly.
    refuted = proposed.join(more, ["a", "b"], "left_anti").select("key")
    apart = undecided.where("blocks > 1").select("key")
    again = _split_buckets(members.join(refuted.unionByName(apart).distinct(), "key", "left_semi"), groups, classes)
    last = stored(_cross_links(again, classes, sets, percent, exact=True).select("a", "b").distinct(), "links")
    if not last.isEmpty():
        groups = stored(components(links.unionByName(last)), "groups")

    named = classes.join(groups, "class").groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = classes.join(groups.join(named, "component").select("class", F.col("component_id").alias("linked")), "class", "left") \
        .select("print", F.coalesce("linked", "first_id").alias("component_id"))
    joined = filled.select("doc_id", "n_shingles", "print").join(labels, "print").select("doc_id", "n_shingles", "component_id")
    alone = sketched.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT,
                  width: int = WIDTH) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    It is the row with the smallest id (a null id comes last), then the
    smallest MD5 of the text; of rows equal in both the one whose columns
    are smallest as JSON text.  Rows without a word are linked with nothing and all stay.
    """
    key = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"),
                   F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("print"))
    mark, = free_names(docs, "_key")
    keyed = docs.withColumn(mark, key)
    found = near_duplicates(keyed, mark, text, percent, width).where("kept").groupBy(F.col("doc_id").alias(mark)).agg(
        ((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("repeated"))
    kept = stored(found, "kept")
    once = keyed.join(kept.where("not repeated").select(mark), mark, "left_semi").select(*docs.columns)
    repeated = keyed.join(kept.where("repeated").select(mark), mark, "left_semi")
    row = F.struct(*docs.columns)  # may hold types without an order, so its text decides
    return once.unionByName(repeated.groupBy(mark).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))
