"""Conversations that are formatted as their turns stream by."""

import random

import pytest
from pyspark.sql import functions as F

from rosterlens.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, start string"


def awkward_rows():
    rng = random.Random(8)
    texts = ["", None, "a", "### user: x</turn>\n", "\\h\\", "日本語 <b>", "x" * 500, "line\nline"]
    rows = [(c, rng.choice([None, *range(n)]), rng.choice(["user", "assistant", None, "a:b"]), rng.choice(texts), "own")
            for c, n in [(1, 3), (2, 400), (3, 1), (None, 60), (-7, 9)] for _ in range(n)]
    return rows + rows[:20]


def by_conversation(df):
    return {r["conv_id"]: r for r in df.collect()}


@pytest.mark.parametrize("part_chars", [1, 700, 1 << 20])
def test_parts_joined_are_the_whole_and_the_digests_agree(spark, part_chars):
    turns = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(7)
    whole = by_conversation(chat.format_conversations(turns))
    parts = chat.format_turns(turns, part_chars=part_chars)
    found = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        text, spans, n = found.get(r["conv_id"], ("", [], 0))
        assert (r["part"], r["start"]) == (n, len(text))
        found[r["conv_id"]] = text + r["formatted"], spans + [tuple(s) for s in r["loss_spans"]], n + 1
    assert set(found) == set(whole)
    for c, (text, spans, n) in found.items():
        assert text == whole[c]["formatted"] and spans == [tuple(s) for s in whole[c]["loss_spans"]]
    if part_chars == 1:
        assert found[2][2] > 400
    assert by_conversation(chat.digest_parts(parts)) == by_conversation(chat.conversation_digests(chat.format_conversations(turns)))


def test_other_templates(spark):
    turns = spark.createDataFrame([(1, i, "user", t, "") for i, t in enumerate("abc")] + [(2, 0, "user", "z", "")], SCHEMA)
    template = ("{% set mark = 'S' ~ 'T' %}<{{ mark }}>{% for m in messages %}{% if not loop.first %},{% endif %}{{ loop.index }}{{ m.text | upper }}"
                "{% if loop.last %}!{% endif %}{% set mark = 'inner' %}{% endfor %}{{ mark }}")
    assert {r["conv_id"]: r["formatted"] for r in chat.format_turns(turns, template).collect()} == {1: "<ST>1A,2B,3C!ST", 2: "<ST>1Z!ST"}
    whole = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(turns, template).collect()}
    assert whole == {1: "<ST>1A,2B,3C!ST", 2: "<ST>1Z!ST"}
    for needs_all in ("{{ messages | length }}{% for m in messages %}{% endfor %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}",
                      "{% if true == m %}{% for m in messages %}{% endfor %}{% endif %}", "no loop",
                      "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% set messages = 1 %}{% for m in messages %}{% endfor %}"):
        with pytest.raises(chat.TemplateError, match="whole conversation"):
            chat.format_turns(turns, needs_all)


def test_no_rows(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert chat.format_turns(nothing).collect() == [] and chat.digest_parts(chat.format_turns(nothing)).collect() == []


def test_moved_parts_raise(spark):
    turns = spark.createDataFrame([(1, i, "user", "x" * 50, "") for i in range(40)], SCHEMA)
    moved = chat.format_turns(turns, part_chars=1).orderBy(F.desc("part"))
    with pytest.raises(Exception, match="in one partition, in order"):
        chat.digest_parts(moved).collect()


def test_one_conversation_with_most_rows(spark):
    turns = spark.range(200_000).select(
        F.when(F.col("id") % 10 > 0, F.lit(5).cast("long")).otherwise(F.col("id")).alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    parts = chat.format_turns(turns, part_chars=10_000)
    assert parts.agg(F.max(F.length("formatted"))).first()[0] < 10_100
    found = chat.digest_parts(parts).where("conv_id = 5").first()
    assert found["n_turns"] == 180_000
    assert found == chat.conversation_digests(chat.format_conversations(turns.where("conv_id = 5"))).first()
