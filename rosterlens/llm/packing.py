"""Best-fit packing of token pieces into sequences, by rounds.

Round one packs the pieces of each partition best-fit into bins and emits the
nearly full ones.  Bins that stay underfull become items of the next round,
on fewer partitions, and so on up a tree until one partition is left.  A round
that saves next to nothing ends the wait for all but the emptier half, and for
bins that even the emptiest does not fit into: two bins that fit together hold
one that is at most half full, and of these a task leaves one at most.  A task holds at most about ``ITEMS`` items at any size
of the input; a bin carries its members, at most ``CAPACITY`` of them, so no
join puts the result together.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.llm.shared import stored

CAPACITY = 2048
END_ID = 0  # closes every document
ITEMS = 25_000  # items in one task
NEARLY_FULL = 0.99  # share of the capacity at which a bin is emitted
LEAST_SAVING = 0.005  # after a round that saves a smaller share of the bins only the emptier half goes on
LONG_RUN = re.compile(r"\s{20000}")  # beyond some hundred thousand the fast encoder's pattern gives up
TOKENIZER = "byte_bpe_50k"  # <name>.json and the same vocabulary as ranks, <name>.tiktoken


@lru_cache(maxsize=2)
def _encoders(name: str):
    """Fast encoder for ordinary text, and the tokenizer file itself for the rest: special tokens, very long white space."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    return fast, exact, special


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """Ids of a whole text without added special tokens, then ``END_ID``; null counts as empty."""
    fast, exact, special = _encoders(name)
    if not text:
        ids: list[int] | np.ndarray = []
    elif any(token in text for token in special) or LONG_RUN.search(text):
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_to_numpy(text, disallowed_special=())
    return np.append(np.asarray(ids, "<u4"), np.uint32(END_ID)).astype("<u4")


def piece_bounds(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces; only the first may be shorter than the capacity when cut."""
    first = length % capacity or capacity
    return [(0, first), *((at, at + capacity) for at in range(first, length, capacity))]


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): one row per piece, without the ids themselves."""
    id_type = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for at, value in enumerate(batch.column("text")):
                ids = token_ids(value.as_py(), tokenizer)
                rows += [(at, n, start, end - start, zlib.crc32(ids[start:end].tobytes()))
                         for n, (start, end) in enumerate(piece_bounds(len(ids), capacity))]
            columns = list(zip(*rows)) or [()] * 5
            owner = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [owner, pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], schema.names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms = 0  # bit r is set while a bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[chosen].append(item)
        else:
            room, chosen = capacity, len(bins)
            bins.append([item])
        left = room - length
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins


def _packed(items: pa.Table, capacity: int) -> pa.Table:
    """Best-fit over items (fill, members); the members of a bin follow one another, with their places in it."""
    lengths = items.column("fill").to_numpy()
    members = items.column("members").combine_chunks()
    if isinstance(members, pa.ChunkedArray):
        members = members.chunk(0)
    firsts, flat = members.offsets.to_numpy(), members.values
    bins = best_fit(lengths, capacity)
    order = np.fromiter((i for b in bins for i in b), np.int64, len(lengths))
    per_bin = np.array([len(b) for b in bins])
    ends = np.cumsum(lengths[order])
    begins = ends - lengths[order]  # places of items if all bins stood in one row
    bin_starts = np.repeat(begins[np.concatenate([[0], np.cumsum(per_bin)[:-1]])], per_bin)
    counts = (firsts[1:] - firsts[:-1])[order]
    steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    taken = flat.take(pa.array(np.repeat(firsts[:-1][order], counts) + steps))
    offsets = taken.field("offset").to_numpy() + np.repeat(begins - bin_starts, counts)
    fields = [taken.field(i) for i in range(taken.type.num_fields - 1)] + [pa.array(offsets, pa.int64())]
    bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, np.concatenate([[0], np.cumsum(per_bin)[:-1]])))])
    names = [taken.type.field(i).name for i in range(taken.type.num_fields)]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, names))
    fills = np.add.reduceat(lengths[order], np.concatenate([[0], np.cumsum(per_bin)[:-1]]))
    return pa.table({"fill": pa.array(fills, pa.int64()), "members": lists})


def pack(items: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS) -> DataFrame:
    """Bins (fill, members) from items (fill, members), each fill at most the capacity."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            yield from _packed(pa.Table.from_batches(found), capacity).to_batches(max_chunksize=2000)

    done, waiting = [], stored(items, "items")
    count = waiting.count()
    while count:
        tasks = -(-count // items_per_task)
        # Dealt round robin: even, and the same on every run because the stored rows are.
        bins = stored(waiting.repartition(tasks).mapInArrow(packed, items.schema), "bins")
        made = bins.count()
        full = F.col("fill") >= NEARLY_FULL * capacity
        if tasks == 1:
            done.append(bins)
            break
        if count - made < LEAST_SAVING * count:
            emptiest, middle = bins.where(~full).agg(F.min("fill"), F.percentile_approx("fill", 0.5, 10_000)).first()
            if middle is not None:
                full |= (F.col("fill") >= middle) | (F.col("fill") > capacity - emptiest)
        done.append(bins.where(full))
        waiting = bins.where(~full)
        count = waiting.count()
    return reduce(DataFrame.unionByName, done) if done else waiting


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   tokenizer: str = TOKENIZER, items_per_task: int = ITEMS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null and empty texts are the closing id alone.  Repeated rows are packed as
    often as they stand, null ids included.  Texts of any length are encoded
    whole; full pieces are sequences of their own.  Other columns do not take
    part.  An empty table gives an empty result.
    """
    pieces = token_pieces(docs, id_column, text, capacity, tokenizer)
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    rows = stored(pieces.select(F.col("length").alias("fill"), F.array(member).alias("members")), "pieces")
    bins = rows.where(F.col("fill") == capacity).unionByName(pack(rows.where(F.col("fill") < capacity), capacity, items_per_task))
    # Numbered in a step of its own: next to the explode, every member would get a number.
    numbered = bins.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("m", F.explode("members"))
    return numbered.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
