"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import settle

# Letters of other alphabets that look like Latin ones, and characters used in place of letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
              "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ι": "i",
              "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "​‌‍⁠﻿­"
# Insults known beforehand, with the weight they have until labels give another, and harmless phrases.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")
SEED_WEIGHT = 4.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "rodeo clown", "idiot proof", "scum line")

#: Bound of the labelled sample (documents a class); what is learned from it is chosen by thresholds alone.
SAMPLE = 4_000
#: Lengths of the word starts that may be patterns; whole words of any length may be.
PREFIXES = range(3, 8)
FOLDS = 5

_FOLD = str.maketrans({**HOMOGLYPHS, **{chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)},
                       **dict.fromkeys(INVISIBLE)})
_PLAIN = str.maketrans(SUBSTITUTES)
_RUN = re.compile(r"[0-9@$]+")
_BETWEEN = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")
_WORDS = re.compile(r"[^\W\d_]+")


# Seed words by the form in which 1 for i and 1 for l are the same.
_SEEDS = {w.replace("l", "i"): w for w in SEED_WORDS}
_LONGEST_SEED = max(map(len, SEED_WORDS))


def _in_word(ch: str) -> bool:
    return ch.isalnum() or ch in "@$"


def _seed(s: str, a: int, b: int) -> str:
    """The letters of ``s[a:b]`` if its token is a seed word, else nothing."""
    left, right = a, b
    while left and right - left <= _LONGEST_SEED and _in_word(s[left - 1]):
        left -= 1
    while right < len(s) and right - left <= _LONGEST_SEED and _in_word(s[right]):
        right += 1
    return _SEEDS.get(s[left:right].translate(_PLAIN).replace("l", "i"), "")[a - left:b - left]


def _letters(m: re.Match) -> str:
    s, a, b = m.string, m.start(), m.end()
    before, after = a > 0 and s[a - 1].isalpha(), b < len(s) and s[b].isalpha()
    if not (before or after):
        return m.group()
    plain = m.group().translate(_PLAIN)
    if b - a <= 2:
        return plain
    signs = after and not (a and _in_word(s[a - 1])) and not any(x.isdigit() for x in m.group())
    return plain if signs or (before and after and plain.isalpha()) else _seed(s, a, b) or m.group()


def fold(text: str) -> str:
    """Lower case, look-alike letters and digits beside letters made plain, invisible characters gone.

    A run of three or more is made plain between letters if every digit stands for
    one, if it is of signs before a letter, or if its token is a seed word.
    """
    s = text.lower()
    if not s.isascii():
        s = s.translate(_FOLD)
    return _BETWEEN.sub("i", _RUN.sub(_letters, s))


@dataclass(frozen=True)
class Model:
    """``patterns``: (text, whole word or start of a word, weight); the rest turns hits into a probability."""

    patterns: tuple[tuple[str, bool, float], ...]
    phrases: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]


def features(weight: float, hits: int, words: int) -> list[float]:
    """Weight of the hits as such and by length."""
    return [weight, math.log1p(max(weight, 0.0)), math.log1p(words), weight / math.sqrt(words + 1.0),
            math.log1p(200.0 * max(weight, 0.0) / (words + 10.0)), float(hits > 0), float(hits > 1)]


@lru_cache(maxsize=8)
def _automaton(patterns: tuple, phrases: tuple) -> ahocorasick.Automaton | None:
    found: dict[str, list] = {}
    for text, whole, weight in patterns:
        found.setdefault(text, []).append((1 if whole else 0, len(text), weight))
    for text in phrases:
        found.setdefault(text, []).append((2, len(text), 0.0))
    machine = ahocorasick.Automaton()
    for text, kinds in found.items():
        machine.add_word(text, kinds)
    machine.make_automaton()
    return machine if found else None


def matches(text: str, patterns: tuple, phrases: tuple) -> tuple[float, int, int]:
    """Weight of all hits, their number, and the words of ``text``; of several at one word the longest counts."""
    s = fold(text)
    machine = _automaton(patterns, phrases)
    best: dict[int, tuple[int, int, float]] = {}
    harmless: list[tuple[int, int]] = []
    if machine is not None:
        end = len(s)
        for stop, kinds in machine.iter(s):
            after = stop + 1 == end or not s[stop + 1].isalpha()
            for kind, size, weight in kinds:
                start = stop + 1 - size
                if (start and s[start - 1].isalpha()) or (kind and not after):
                    continue
                if kind == 2:
                    harmless.append((start, stop + 1))
                else:
                    best[start] = max(best.get(start, (0, 0, 0.0)), (size, kind, weight))
    for a, b in harmless:
        for start in [x for x in best if a <= x < b]:
            del best[start]
    return sum(w for _, _, w in best.values()), len(best), len(s.split())


def probability(model: Model, text: str | None) -> float:
    x = np.array(features(*matches(text or "", model.patterns, model.phrases)))
    z = model.coefficients[0] + float(((x - model.mean) / model.scale) @ np.array(model.coefficients[1:]))
    return 1.0 / (1.0 + math.exp(-min(max(z, -35.0), 35.0)))


def remainder(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Up to ``bound`` labelled documents a class that are not held out, by least hash of the id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    parts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "_id")  # at most 2 x bound ids: broadcast
    return settle(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
                  .select("text", "toxic", (remainder(F.col("_id")) == FOLDS - 1).alias("late")), "sample")


def _counts(frames: Iterator[pd.DataFrame], of: Callable[[list[str]], Iterable[str]]) -> Iterator[pd.DataFrame]:
    """Occurrences and documents by class of what ``of`` makes of a text's words, over one partition of the sample."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            words = _WORDS.findall(fold(text or ""))
            here = Counter(of(words))
            seen[toxic].update(here)
            held[toxic].update(here.keys())
            seen[toxic][""] += len(words)
            held[toxic][""] += 1
    keys = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(keys), 50_000):
        part = keys[at:at + 50_000]
        yield pd.DataFrame({"feature": part, "c0": [seen[0][k] for k in part], "c1": [seen[1][k] for k in part],
                            "d0": [held[0][k] for k in part], "d1": [held[1][k] for k in part]})


COUNTS = "feature string, c0 long, c1 long, d0 long, d1 long"


def _words_and_starts(words: list[str]) -> Iterator[str]:
    """Whole words, marked by a space, and starts of words."""
    for w in words:
        yield w + " "
        for k in PREFIXES:
            if len(w) >= k:
                yield w[:k]


def _phrases(sample: DataFrame, named: frozenset[str]) -> list[str]:
    """Pairs of words with a word of the lexicon that stand in clean documents of the sample and in no toxic one."""

    def pairs(words: list[str]) -> Iterator[str]:
        for a, b in zip(words, words[1:]):
            if a in named or b in named:
                yield f"{a} {b}"

    found = (sample.filter(~F.col("late")).select("text", "toxic")
             .mapInPandas(lambda frames: _counts(frames, pairs), COUNTS)
             .groupBy("feature").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
             .filter((F.col("feature") != "") & (F.col("d0") >= 3) & (F.col("d1") == 0)))
    return [r["feature"] for r in found.orderBy(F.desc("d0"), "feature").collect()]  # of a bounded sample


def _lexicon(sample: DataFrame) -> tuple[tuple, tuple]:
    stats = settle(sample.filter(~F.col("late")).select("text", "toxic")
                   .mapInPandas(lambda frames: _counts(frames, _words_and_starts), COUNTS)
                   .groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "d0", "d1")]), "stats")
    total = stats.filter(F.col("feature") == "").first()
    seeds = tuple((w, True, SEED_WEIGHT) for w in SEED_WORDS)
    if total is None or not (total["c0"] and total["c1"]):
        return seeds, EXCEPTIONS
    n0, n1 = float(total["c0"]), float(total["c1"])
    expected = (F.col("c0") + 0.5) * (n1 / n0)
    weight = F.log((F.col("c1") + 0.5) / expected)
    surplus = (F.col("c1") - expected) / F.sqrt(expected)
    least = max(4, int(total["d1"]) // 60)
    top = (stats.filter((F.col("feature") != "") & (F.col("d1") >= least))
           .withColumn("weight", weight).withColumn("surplus", surplus)
           .filter((F.col("weight") >= 1.0) & (F.col("surplus") >= 6.0))
           .select("feature", "weight").collect())  # of a bounded sample
    chosen: dict[str, float] = {}
    for row in sorted(top, key=lambda r: (len(r["feature"]), r["feature"])):
        word = row["feature"]
        shorter = next((chosen[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in chosen), None)
        if shorter is None or abs(row["weight"] - shorter) > 0.7:
            chosen[word] = float(row["weight"])
    patterns = tuple((w.rstrip(" "), w.endswith(" "), x) for w, x in chosen.items())
    patterns += tuple(s for s in seeds if (s[0], True) not in {(p[0], p[1]) for p in patterns})
    named = frozenset(w.rstrip(" ") for w in chosen if w.endswith(" "))
    phrases = _phrases(sample, named) if named else []
    return patterns, tuple(dict.fromkeys((*EXCEPTIONS, *phrases)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    b, penalty = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        grad = a.T @ (p - y) + penalty @ b
        b -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, grad)
    return b


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Learn the lexicon from three fifths of the ids and its scale from one fifth; one fifth is held out.

    At most ``bound`` documents a class are read for it.  Without labels of both
    classes the seed words with fixed scales are used.
    """
    sample = _sample(docs, labels, bound)
    patterns, phrases = _lexicon(sample)

    def measured(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [features(*matches(t or "", patterns, phrases)) for t in f["text"]]
            yield pd.DataFrame({"x": rows, "toxic": f["toxic"]})

    rows = sample.filter("late").select("text", "toxic").mapInPandas(measured, "x array<double>, toxic int").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if len(rows) < 20 or not 0 < y.sum() < len(y):
        return Model(patterns, phrases, (0.0,) * 7, (1.0,) * 7, (-3.0, 0.0, 1.5, 0.0, 0.0, 0.5, 0.0, 0.0))
    x = np.array([r["x"] for r in rows])
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of arrival
    x, y = x[order], y[order]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    b = _logistic((x - mean) / scale, y)
    return Model(patterns, phrases, tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, b)))


def scored(text: Column, model: Model) -> Column:
    """Probability that ``text`` is toxic; a null text counts as empty."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([probability(model, t) for t in texts], dtype="float64")

    return run(text)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Only text enters a score.  Null and empty texts get the score of a text
    without words or hits; repeated rows give equal rows; other columns are
    ignored; an empty table gives no rows.  Labels with null ids or values teach
    nothing.
    """
    model = train(docs, labels)
    out = docs.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not judged toxic, with all columns; the model learns from ``known`` texts."""
    return docs.filter(scored(F.col("text"), train(known, labels)) < 0.5)
