"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule names a measure and the range in which a document passes.  All
measures of a row come from two arrays (its words and its lines), so the plan
is a scan and a projection: no shuffle, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.shared import let, words_of


@dataclass(frozen=True)
class Rule:
    measure: str
    low: float | None = None
    high: float | None = None


# The base limits of the contract, and the usual limits of published filters for web text.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RULES = (
    Rule("n_words", low=50, high=1_000_000),
    Rule("mean_word_length", low=2, high=15),
    Rule("symbol_ratio", high=0.25),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("repeat_word_ratio", high=0.5),
)
# Frequent function words of the languages at hand.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "it", "on", "be", "are", "this", "have",
    "de", "la", "le", "les", "des", "et", "est", "une", "un", "que", "qui", "dans", "pour", "par", "sur", "du",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "für", "auf", "sich",
    "el", "los", "las", "una", "por", "con", "para", "del", "se", "no", "y", "en", "es",
)
SYMBOLS = r"[#*$%&|<>]"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are sorted with their places, so equal ones stand side by side;
    the covered words follow from the gaps between the marked places.
    """
    def marked(tagged: Column) -> Column:
        same = lambda i, j: F.get(tagged, i)["w"] == F.get(tagged, j)["w"]
        return F.transform(
            F.filter(F.sequence(F.lit(0), F.size(tagged) - 1),
                     lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))),
            lambda i: F.get(tagged, i)["i"])

    def covered(places: Column) -> Column:
        # The gap behind the last place is null, and counts nothing beyond its own window.
        gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: b - a)
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(width + F.aggregate(
            gaps, F.lit(0), lambda total, gap: total + F.when(gap < width, gap).when(gap.isNull(), 0).otherwise(width)))

    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]).alias("w"), i.alias("i")))
    found = let(F.sort_array(windows(words)), lambda tagged: let(F.sort_array(marked(tagged)), covered))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(found).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """Columns of every measure; the words and the lines are bound by :func:`apply_rules`."""
    words, lines = F.col("_words"), F.col("_lines")
    n_words = F.size(words).cast("long")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    n_lines = F.size(lines)
    counted = {
        "n_words": n_words,
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }
    n = F.col
    return counted | {
        "mean_word_length": share(n("word_chars"), n("n_words")),
        "symbol_ratio": share(n("n_symbols"), n("n_words")),
        "stop_word_ratio": share(F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))), n("n_words")),
        "dup_line_ratio": share(n("n_dup_lines"), n_lines),
        "bullet_line_ratio": share(F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]"))), n_lines),
        "ellipsis_line_ratio": share(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)$"))), n_lines),
        "repeat_word_ratio": share(n("n_repeat_words"), n("n_words")),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One Boolean column that is true where every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (F.col(rule.measure) >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (F.col(rule.measure) <= F.lit(rule.high))
    return verdict


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
                carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, all measures, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails.  Equal rows get equal
    verdicts and all stay; texts of any length are measured whole.  Other
    columns of the input do not take part, so their names cannot clash.
    """
    lines = F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n"), lambda x: x.rlike(_HAS_WORD))
    shaped = docs.select(*carry, F.col(text).alias("_text")).withColumns({"_words": words_of(F.col("_text")), "_lines": lines})
    columns = measures(F.col("_text"))
    base = [c for c in columns if c.startswith("n_") or c == "word_chars"]
    counted = shaped.select("*", *[columns[c].alias(c) for c in base])
    measured = counted.withColumns({name: c for name, c in columns.items() if name not in base})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules)) \
        .drop("_text", "_words", "_lines")
