"""Global ranks, running sums and exact quantiles without a one-task window.

``running_totals``
    Inclusive prefix sums in value order.  Values are cut into buckets, the
    (group, bucket) table gives the offsets, and each bucket is summed on its
    own.  The cuts only balance the work; the sums are exact wherever they fall.

``exact_quantiles``
    One scan combines the rows to (group, value) counts; the rest works on
    those.

``hash_slices``
    Consecutive slices of the hash order of an id, with exact sizes per class.
    Only rows that share a hash prefix with a cut are ever ranked, so the fact
    table itself is not shuffled at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.sources.tables import settle

BUCKET_ROWS = 50_000  # counted rows in a bucket, about
FEWEST_BUCKETS, MOST_BUCKETS = 8, 4096  # beyond the last, buckets grow; cut points are one array per plan
HASH_PREFIX = 4  # hex digits: at most 65,536 prefixes per class, of which only those at a cut are ranked


def _bucketed(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: the number of cut points below the value, by binary search.

    The cut points are approximate quantiles, held as one scalar array.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    cuts = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)).scalar()
    steps = [buckets >> i for i in range(1, buckets.bit_length())]
    search = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda low, step: F.when(F.element_at("_cuts", low + step) < F.col(value), low + step).otherwise(low))
    return df.withColumn("_cuts", cuts).withColumn("_bucket", search).drop("_cuts")


def running_totals(distinct: DataFrame, value: str, sums: Sequence[str], group: Sequence[str] = (),
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``cum_x`` (ascending, inclusive), ``total_x`` and ``_bucket``.

    ``distinct`` has one row per (group, value): combine first, so that a value
    shared by a third of all rows is one row here.  It is settled once and
    counted, which gives the number of buckets; one plan serves all sizes.
    """
    group = list(group)
    distinct = settle(distinct)
    wanted = -(-distinct.count() // bucket_rows)
    buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (wanted - 1).bit_length() if wanted > 1 else 1))
    keyed = _bucketed(distinct, value, buckets)
    # One row per (group, bucket): at most ``buckets`` rows in any window group.
    per_bucket = keyed.groupBy(*group, "_bucket").agg(*[F.sum(s).alias(f"_b_{s}") for s in sums])
    everything = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_g_bucket"),
        *[F.coalesce(F.sum(f"_b_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(everything).alias(f"total_{s}") for s in sums])
    if not group:
        offsets = F.broadcast(offsets)  # at most ``buckets`` rows

    match = F.col("_bucket") == F.col("_g_bucket")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(offsets, match).select(
        *distinct.columns, *[(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums], "_bucket")


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float], group: Sequence[str] = (),
                    moments: bool = False, **ranking) -> DataFrame:
    """Interpolated quantiles per group, one column per entry of ``probabilities``.

    ``moments`` adds ``min``, ``max`` and ``avg``, which the value counts give
    without another scan.  No task ever holds all values of a large group.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, value, ["n"], group, **ranking)
    picks, results = [], []
    for name, p in probabilities.items():
        position = lambda n: (F.col(n) - 1) * F.lit(float(p))  # noqa: B023, E731
        for end, side in (("lo", F.floor), ("hi", F.ceil)):
            # The first value whose running count passes the 0-based rank.
            picks.append(F.min(F.when(F.col("cum_n") > side(position("total_n")), F.col(value))).cast("double")
                         .alias(f"_{end}_{name}"))
        at, lo, hi = position("_rows"), F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    found = ranked.groupBy(*group).agg(
        F.max("total_n").alias("_rows"), *picks, F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("avg"))
    return found.select(*group, *results, *(["min", "max", "avg"] if moments else []))


def approximate_quantiles(df: DataFrame, value: str, probabilities: dict[str, float], group: Sequence[str] = (),
                          moments: bool = False, accuracy: int = 10_000) -> DataFrame:
    """One-pass quantiles with rank error of at most rows / ``accuracy``; ``moments`` as in the exact form."""
    extra = [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg")] if moments else []
    return df.groupBy(*group).agg(*[F.percentile_approx(value, p, accuracy).cast("double").alias(name)
                                    for name, p in probabilities.items()], *extra)


# --- slices of the hash order ---------------------------------------------------

def hash_slices(df: DataFrame, id_column: str, label: str,
                cut_ranks: Callable[[dict[int, int]], dict[int, list[int]]],
                seed: int, classes: Sequence[int] = (0, 1), name: str = "slice") -> DataFrame:
    """Number of class-wise cut ranks that lie before each row in hash order.

    ``cut_ranks`` turns the rows per class into ascending ranks per class: a
    row at 1-based hash rank r of its class gets the number of ranks smaller
    than r.  Ids must be unique.  A row whose label is not in ``classes`` gets
    null.

    The cut points are found right away, in two scans of the id and the label;
    the result is a projection of ``df`` that compares with them.
    """
    hashed = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")))
    keyed = df.where(F.col(label).isin(*classes)).select(
        F.col(label).alias("_label"), F.col(id_column).alias("_id"), hashed.alias("_hash")).withColumn(
        "_prefix", F.substring("_hash", 1, HASH_PREFIX))

    # At most len(classes) * 16**HASH_PREFIX rows, so one row per class is left to collect.
    counts = settle(keyed.groupBy("_label", "_prefix").agg(F.count(F.lit(1)).alias("_n")))
    per_class = counts.groupBy("_label").agg(F.sum("_n").alias("_n")).collect()
    ranks = cut_ranks({row["_label"]: row["_n"] for row in per_class})

    # The prefix every cut falls into, and the place of the cut inside it.
    upto = Window.partitionBy("_label").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumn("_cum", F.sum("_n").over(upto))
    inside = F.lit(False)
    for value, cuts in ranks.items():
        for rank in cuts:
            inside = inside | ((F.col("_label") == value) & (F.col("_cum") >= rank) & (F.col("_cum") - F.col("_n") < rank))
    hit = cumulated.where(inside).collect()  # at most classes x cuts rows

    # Only rows in a cut's own prefix: about rows / 16**HASH_PREFIX for each.
    wanted = F.lit(False)
    for row in hit:
        wanted = wanted | ((F.col("_label") == row["_label"]) & (F.col("_prefix") == row["_prefix"]))
    order = Window.partitionBy("_label", "_prefix").orderBy("_hash", "_id")
    place, picked = F.row_number().over(order), F.lit(False)
    for row in hit:
        for rank in ranks[row["_label"]]:
            picked = picked | ((F.col("_label") == row["_label"]) & (F.col("_prefix") == row["_prefix"])
                               & (F.col("_place") == rank - row["_cum"] + row["_n"]))
    ends = keyed.where(wanted).withColumn("_place", place).where(picked).collect()  # classes x cuts rows
    last_rows = {(r["_label"], r["_prefix"], r["_place"]): r for r in ends}
    prefixes = {(row["_label"], rank): (row["_prefix"], rank - row["_cum"] + row["_n"])
                for row in hit for rank in ranks[row["_label"]] if row["_cum"] - row["_n"] < rank <= row["_cum"]}

    def is_after(value: int, rank: int) -> Column:
        if rank <= 0:
            return F.lit(1)
        last = last_rows[(value, *prefixes[value, rank])]
        tie = (F.col("_hash") == last["_hash"]) & (F.col(id_column) > F.lit(last["_id"]))
        return F.when((F.col("_hash") > last["_hash"]) | tie, 1).otherwise(0)

    slices = F.lit(None).cast("int")
    for value, cuts in ranks.items():
        slices = F.when(F.col(label) == value, sum((is_after(value, r) for r in cuts), F.lit(0))).otherwise(slices)
    return df.withColumn("_hash", hashed).select(*df.columns, slices.alias(name))
