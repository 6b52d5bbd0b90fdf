"""Mixing sources to target weights by weighted sampling without replacement.

Efraimidis and Spirakis: a document with weight w gets the key E / w, where E
is exponential; taking documents by ascending key is sampling in proportion to
the weights.  A source whose target is above its size first gives complete
epochs, then a fraction of its documents in key order, up to the remaining
budget.

No task sorts a source.  Keys fall into narrow logarithmic buckets; sums per
(source, bucket) show in which bucket the budget ends, and only the documents
of that one bucket are ranked.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.llm.shared import free_names, stored, word_count, words_of

WEIGHTS = (1, 2, 3)  # of the sources in code-point order, repeating
MAX_EPOCHS = 3
BUCKETS_PER_OCTAVE = 256
LEAST_QUALITY, SYMBOL_COST = 0.05, 4
SYMBOLS = r"[#*$%&|<>]"


def quality_weight(size: Column, symbols: Column) -> Column:
    """Share of words against symbols, at least ``LEAST_QUALITY``."""
    return F.greatest(F.lit(LEAST_QUALITY), F.when(size > 0, size / (size + SYMBOL_COST * symbols)).otherwise(F.lit(0.0)))


def exponential_key(identity: Column, weight: Column) -> Column:
    """E / weight with E exponential, from the first 52 bits of the MD5 of a row's identity."""
    bits = F.conv(F.substring(F.md5(identity), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / weight


def sized_rows(docs: DataFrame, id_column: str, text: str, source: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, key): what the mix needs of a row, and the columns ``carry``.  Null texts have size 0."""
    content = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.regexp_count(content, F.lit(SYMBOLS)).alias("symbols"),
        F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("|"), content).alias("identity"),
        *carry)
    return counted.select("id", "source", "size", *carry, exponential_key(
        F.col("identity"), quality_weight(F.col("size"), F.col("symbols"))).alias("key"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, rest): one row per source.

    The weights share the total of all sizes.  No target exceeds
    ``max_epochs`` times its source; the excess goes to the others by weight.
    With sources ordered by cap over weight, the capped ones come first, and
    the first that holds its share fixes the share of all that follow.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", place.alias("place"), weight.alias("weight")).withColumn(
        "cap", max_epochs * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    all_of = Window.partitionBy()
    shared = ranked.withColumn("unit", (F.sum("source_size").over(all_of) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                               .cast("double") / F.sum("weight").over(after)).withColumn("order", F.row_number().over(by_cap))
    holds = F.when(F.col("cap") / F.col("weight") >= F.col("unit"), F.struct("order", "unit"))
    fixed = shared.withColumn("unit", F.min(holds).over(all_of)["unit"])
    target = F.least(F.col("cap").cast("double"), F.col("unit") * F.col("weight"))
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return fixed.select("source", "source_size", target.alias("target")).withColumn("epochs", epochs).withColumn(
        "rest", budget - F.col("epochs") * F.col("source_size"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken) and the columns ``carry`` for every row.

    ``taken`` counts words: complete epochs of the row, plus the whole row or
    nothing of it in the fractional part; the one document on which the budget
    ends gives the words that are still missing.  A null source is a source of
    its own, last in order.  Null and empty texts have size 0 and give nothing.
    Rows equal in id and text share what their group takes evenly, rounded
    down.  The same input always gives the same mix.
    """
    rows = stored(sized_rows(docs, id_column, text, source, carry), "rows")
    targets = stored(source_targets(rows, weights, max_epochs), "targets")
    bucket = F.floor(F.log2("key") * BUCKETS_PER_OCTAVE).cast("long")
    keyed = rows.withColumn("bucket", bucket)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = targets.withColumnRenamed("source", "s")
    ends = sums.join(named.select("s", "rest"), same("source", "s")).where("upto >= rest and upto - words < rest").select(
        F.col("source").alias("e"), F.col("bucket").alias("end"), (F.col("upto") - F.col("words")).alias("before"))
    # One row per source; without a rest there is no end and nothing fractional is taken.
    plan = stored(named.join(ends, same("s", "e"), "left").select(
        "s", "source_size", "target", "epochs", "rest", F.coalesce("end", F.lit(-2**62)).alias("end"),
        F.coalesce("before", F.lit(0)).alias("before")), "plan")

    placed = keyed.join(plan, same("source", "s"))
    last = placed.where("bucket = end").groupBy("source", "id", "size", "key", "rest", "before").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(earlier), F.lit(0))
    given = F.floor(F.greatest(F.lit(0), F.least(room, F.col("n") * F.col("size"))) / F.col("n")).cast("long")
    partial = last.select(F.col("source").alias("p_source"), F.col("id").alias("p_id"), F.col("size").alias("p_size"),
                          F.col("key").alias("p_key"), given.alias("given"))
    final = ["id", "size", "source_size", "target", *carry]
    whole = placed.where("bucket <> end").select(
        *final, (F.col("epochs") * F.col("size") + F.when(F.col("bucket") < F.col("end"), F.col("size")).otherwise(0)).alias("taken"))
    ending = placed.where("bucket = end").join(
        partial, same("source", "p_source") & same("id", "p_id") & (F.col("size") == F.col("p_size")) & (F.col("key") == F.col("p_key"))
    ).select(*final, (F.col("epochs") * F.col("size") + F.col("given")).alias("taken"))
    return whole.unionByName(ending).withColumnRenamed("id", id_column)


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
                    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix as rows of the input: a document stands once for each time it is taken whole.

    The document on which a source's budget ends stands once more with its
    first words, joined by spaces.  Documents not taken are left out; columns
    stay, ``n_chars`` follows a cut text.  Rows equal in id are told apart by
    their texts and sources.
    """
    own_print, origin, row_id, row_text, row_source, size, take, part = free_names(
        docs, "_print", "_from", "_id", "_text", "_source", "_size", "_taken", "_part")
    marked = docs.withColumns({own_print: F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))), origin: F.col(source)})
    known = marked.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"),
                          F.col(own_print).alias("print"), F.col(origin).alias("origin"))
    # Rows equal in id, text and source take the same number of words.
    taken = mix_sources(known, weights=weights, max_epochs=max_epochs, carry=("print", "origin")).groupBy(
        F.col("doc_id").alias(row_id), F.col("print").alias(row_text), F.col("origin").alias(row_source), F.col("size").alias(size)) \
        .agg(F.max("taken").alias(take)).where(F.col(take) > 0)
    joined = marked.join(taken, F.col(id_column).eqNullSafe(F.col(row_id)) & (F.col(own_print) == F.col(row_text))
                         & F.col(origin).eqNullSafe(F.col(row_source)))
    times, left = F.floor(F.col(take) / F.col(size)).cast("int"), (F.col(take) % F.col(size)).cast("int")
    parts = F.when(left > 0, F.concat(F.array_repeat(F.lit(0), times), F.array(left))).otherwise(F.array_repeat(F.lit(0), times))
    placed = joined.withColumn(part, F.explode(parts))
    cut = F.when(F.col(part) == 0, F.col(text)).otherwise(F.array_join(F.slice(words_of(F.col(text)), 1, F.col(part)), " "))
    result = placed.withColumn(text, cut)
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.when(F.col(part) == 0, F.col("n_chars")).otherwise(
            F.char_length(text)).cast(docs.schema["n_chars"].dataType))
    return result.select(*docs.columns)
