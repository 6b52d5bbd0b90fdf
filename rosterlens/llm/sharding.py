"""Extendible hashing into shards of bounded size.

A directory is indexed by the first bits of a key's hash.  All rows start in
one bucket; only buckets above the byte limit split on another bit, until each
fits.  The table is read once to (key hash, bytes); every round then groups the
rows of the oversized buckets by a few more bits, decides all levels within
those bits on the grouped table, and closes what fits.  The number of new bits
follows from the largest bucket, so a round's grouped table has a few rows per
future shard.

Rows that share the whole key hash (repeated ids) go on splitting on bits of a
row hash.  A single row above the limit is a shard of its own.  Only built-in
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.shared import stored

SHARD_BYTES = 1 << 20  # one read request of a training loader
KEY_BITS = 60  # bits of the key's hash; as many bits of the row hash follow
MAX_STEP = 14  # new bits in one round


def key_hash(key: Column) -> Column:
    """First 60 bits of the MD5 of the key as text; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column) -> Column:
    """First ``depth`` bits of a row's path: key bits, or row bits below ``KEY_BITS``."""
    return F.when(depth <= KEY_BITS, F.call_function("shiftright", F.col("code"), (F.lit(KEY_BITS) - depth).cast("int"))).otherwise(
        F.call_function("shiftright", F.col("row_code"), (F.lit(2 * KEY_BITS) - depth).cast("int")))


def _level(rows: DataFrame, start: int, step: int, limit: int) -> DataFrame:
    """(owner, fine, depth, closed): the depth at which each group of ``start + step`` bits comes to rest."""
    grouped = rows.withColumn("fine", _prefix(F.lit(start + step))).groupBy("owner", "fine").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    fits, whole = F.lit(None).cast("int"), grouped
    for more in range(step, -1, -1):
        name = f"_{more}"
        over = Window.partitionBy("owner", name)
        whole = whole.withColumn(name, F.call_function("shiftright", F.col("fine"), F.lit(step - more))).withColumns(
            {f"b{name}": F.sum("bytes").over(over), f"n{name}": F.sum("n").over(over)})
        fits = F.when((F.col(f"b{name}") <= limit) | (F.col(f"n{name}") == 1), start + more).otherwise(fits)
    return whole.select("owner", "fine", F.coalesce(fits, F.lit(start + step)).alias("depth"), fits.isNotNull().alias("closed"))


def extendible_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(key, bytes, depth, prefix, shard_bytes, shard_rows) for every row.

    A shard is a (depth, prefix) pair: rows whose path starts with these bits.
    Null texts have no bytes; null keys share one hash and split by row.
    Repeated rows stay.  An empty table gives an empty result.  Other columns
    do not take part.
    """
    rows = stored(docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
                  .withColumn("code", key_hash(F.col("key"))), "sized")
    open_rows = rows.withColumn("row_code", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << KEY_BITS) - 1))) \
        .withColumn("owner", F.lit(0).cast("long"))
    shards, start = None, 0
    while start < 2 * KEY_BITS:
        sizes = open_rows.groupBy("owner").agg(F.sum("bytes").alias("b")).agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
        if shards is not None and not sizes["n"]:
            break
        parts = max(1, -(-(sizes["b"] or 0) // limit))
        edge = KEY_BITS if start < KEY_BITS else 2 * KEY_BITS  # a round reads key bits or row bits, not both
        step = min(MAX_STEP, parts.bit_length() + 2, edge - start)
        levels = stored(_level(open_rows, start, step, limit), "levels")
        keyed = open_rows.withColumn("fine", _prefix(F.lit(start + step))).join(levels, ["owner", "fine"])
        closed = keyed.where("closed").select("key", "bytes", "depth", _prefix(F.col("depth")).alias("prefix"), "owner")
        shards = closed if shards is None else shards.unionByName(closed)
        # Below the key bits a path is no longer a number of 64 bits: the bucket above is remembered as the owner.
        owner = F.when(F.lit(start + step <= KEY_BITS), F.col("fine")).otherwise(F.xxhash64("owner", "fine"))
        open_rows = stored(keyed.where(~F.col("closed")).select("key", "bytes", "code", "row_code", owner.alias("owner")), "open")
        start += step
    # All rows of a shard share depth and prefix; below the key bits the owner tells shards of one prefix apart.
    sized = stored(shards, "placed")
    apart = F.when(F.col("depth") > KEY_BITS, F.col("owner")).otherwise(F.lit(0)).alias("apart")
    totals = sized.groupBy("depth", "prefix", apart).agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return sized.select("key", "bytes", "depth", "prefix", apart).join(totals, ["depth", "prefix", "apart"]).select(
        F.col("key").alias(key), "bytes", "depth", "prefix", "shard_bytes", "shard_rows")


def directory(shards: DataFrame) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows): one row per shard; the global depth is the largest."""
    return shards.select("depth", "prefix", "shard_bytes", "shard_rows").distinct()
