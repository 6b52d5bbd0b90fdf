"""Category codes as a table, for columns with more values than a driver should hold.

A value's code is its place in code-point order, from 0.  Distinct values are
dealt to ranges, each range is numbered on its own, and the counts of the ranges
before it are added; encoding is a join, which Spark broadcasts where the table
is small and shuffles where it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.operators.prep import MISSING
from rosterlens.sources.tables import settle

UNSEEN = ("error", "null")


def dictionary(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """(value, code) of every value of a column; null counts as the text for missing values.

    ``ranges`` is the number of ranges, by default the shuffle partitions of the
    session.  The codes do not depend on it.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    values = df.select(text.alias("value")).distinct()
    by_range = (F.col("value"),) if ranges is None else (ranges, F.col("value"))
    # Settled, so that a value's range is a stored fact and not computed twice.
    dealt = settle(values.repartitionByRange(*by_range).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return dealt.withColumn("place", place).join(F.broadcast(offsets), "part").select(
        "value", (F.col("offset") + F.col("place") - 1).cast("long").alias("code"))


def encode_column(df: DataFrame, column: str, codes: DataFrame, unseen: str = "error") -> DataFrame:
    """Replace a column by its code, whatever the number of values.

    Null is encoded as the text for missing values.  A value that the table does
    not have is an error, or null with ``unseen='null'``.  Other columns stay,
    also those with the names of the table's.
    """
    if unseen not in UNSEEN:
        raise ValueError(f"unseen must be one of {UNSEEN}")
    rows = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value"))
    joined = rows.join(codes.select("value", "code"), "value", "left")
    code = F.col("code")
    if unseen == "error":
        code = F.coalesce(code, F.raise_error(F.concat(F.lit(f"unseen value for {column}: "), F.col("value"))).cast("long"))
    return joined.select(*[code.alias(c) if c == column else F.col("row").getField(c).alias(c) for c in df.columns])


def decode_column(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Replace a code by its value; a code that the table does not have, and null, give null."""
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(column).cast("long").alias("code"))
    joined = rows.join(codes.select("code", "value"), "code", "left")
    return joined.select(*[F.col("value").alias(c) if c == column else F.col("row").getField(c).alias(c) for c in df.columns])
