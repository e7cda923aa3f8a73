"""Cases that once failed: tight groups below the threshold, long digit runs, the smallest id, clashing names, equal rows without ids."""

import random

import pytest
from pyspark.sql import functions as F

from offergrid.llm import exact_dedup, mixing, near_dedup, personal
from tests.llm.test_operators import _classes


def _tight(seed):
    """Copies of one text with changes that keep most pairs below 0.8, chains among them, and copies that share a rare change."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(120)], {}
    spare = [word() for _ in range(6)]
    for i in range(70):
        words = list(base)
        for _ in range(rng.choice((1, 3, 4, 5))):
            words[rng.randrange(120)] = rng.choice(spare) if rng.random() < 0.4 else word()
        if rng.random() < 0.2:
            del words[:rng.choice((4, 9))]
        texts[i] = " ".join(words)
    for i in range(70, 90):  # a chain of small steps away from one of them
        words = texts[i - 1].split()
        words[rng.randrange(len(words))] = word()
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize("seed, few", [(1, 8), (2, 8), (3, 1), (4, 100)])
def test_near_groups_of_a_tight_group(spark, monkeypatch, seed, few):
    monkeypatch.setattr(near_dedup, "FEW_NODES", few)
    texts = _tight(seed)
    want = _classes(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.groups(docs).collect()} == want
    assert 1 < len(set(want.values()))


def test_long_digit_runs():
    zeros = "0" * 5000
    assert [(k, a) for k, a, _ in personal.base_spans(f"{zeros}1.2.3.4 and {zeros}.1.2.3 and {'9' * 5000}.1.2.3")] == [(1, 0), (1, 5012)]


def test_exact_groups_with_the_smallest_id(spark):
    low = -2**63
    docs = spark.createDataFrame([(low, "a b"), (5, "ab"), (None, "a  b"), (7, "a b"), (8, "x"), (low, "y")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {(low, None, 4), (5, None, 4), (None, None, 4), (7, None, 4), (8, 8, 1), (low, low, 1)}


NAMES = ("gone", "_gone", "id", "_id", "sha", "_sha", "_n", "source_", "_source", "size", "_size", "copies", "_copies", "rows", "_rows", "words", "at", "round",
         "_round", "Gone", "h", "n", "body", "node", "label", "key", "_key", "start", "_value", "_chunk", "x.y")


@pytest.mark.parametrize("keep", [near_dedup.keep_rows, exact_dedup.keep_rows, mixing.mixed_rows])
def test_any_column_name_may_stand_beside(spark, keep):
    names = [n for n in NAMES if n != "Gone"]
    rows = [(i, f"some words that stand here {i % 3} " * 3, "s", *[0] * len(names)) for i in range(6)] + [(None, None, None, *[None] * len(names))] * 2
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` int" for n in names]]))
    out = keep(docs)
    assert out.columns == docs.columns and {r[0] for r in out.collect()} - {None} == {r[0] for r in keep(docs.select("doc_id", "text", "source")).collect()} - {None}


def test_equal_rows_without_ids_share_their_copies(spark):
    rows = [(None, "one two three four five six seven eight", "a")] * 1000 + [(1, "word " * 4000, "b"), (2, "word " * 4000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    target = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    taken = {r["source"]: r["n"] for r in mixing.mixed_rows(docs).groupBy("source").agg(F.sum(mixing.words_of(F.col("text"))).alias("n")).collect()}
    assert abs(taken["a"] - target["a"]) <= 8 and abs(taken["b"] - target["b"]) <= 4000
