"""Spelling variants, pigeonring SimHash and source divergence against SQL and brute force on hard cases."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offergrid.llm import divergence, pigeonring, spelling

SCHEMA = ("doc_id long, text string, lang string, source string, word string, n long, gram string, key string, label long, "
          "mark long, node long, term string, p long, value long, item string, v long")


def _docs():
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 11))) for _ in range(40)]

    def slip(w):
        at = rng.randrange(len(w))
        return rng.choice((w[:at] + w[at + 1:], w[:at] + rng.choice("abcxé") + w[at:], w[:at] + rng.choice("abcxé") + w[at + 1:]))

    texts = [" ".join(slip(w) if rng.random() < 0.3 else w for w in rng.choices(stems, weights=range(1, 41), k=rng.randint(1, 120))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "ONE", "two words", texts[0], texts[0] + " x", texts[1].upper(), "y" * 9000, "y" * 9000 + " " + "y" * 9000,
              "y" * 8999, "ßtraße ÉTÉS étés ×÷× don't 漢字漢字 word word", "a\x1cb c\x85d", "aaaaa aaaab aaaaa aaaab aaaaa aaaab aaaaa aaaaa aaaaaa aaaaaa aaaaaa"]
    langs, sources = ("en", "de", None, ""), ("s0", "s0", "s1", None, "", "é")
    rows = [(i, t, langs[i % 7 % 4], sources[i % 6], "w", 1, "g", "k", 2, 3, 4, "t", 5, 6, "i", 7) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (900, "", "fr", "only", *rows[0][4:])]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("new"))
    rows = _docs()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), path, rows


def _same(df, sql, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    got, want = sorted(map(tuple, df.select(*names).collect()), key=str), sorted(cur.fetchall(), key=str)
    assert got and got == want


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def _awkward(spark):
    """No ids and no texts; repeated rows."""
    rows = [(None, "letters letters letters", "en", "a")] * 3 + [(None, None, None, None), (1, "letterz letterz letterz", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


# 11
def test_variants(docs):
    _same(spelling.variants(docs[0]), spelling.SQL, docs[1])


@pytest.mark.parametrize("shortest, longest, frequent", [(2, 4, 3), (2, 3, 1), (3, 5, 8), (2, 5, 10**9)])
def test_near_pairs_are_all_pairs(spark, shortest, longest, frequent):
    rng = random.Random(frequent)
    words = {"".join(rng.choice("ab" if rng.random() < 0.7 else "abc") for _ in range(rng.randint(5, 8))) for _ in range(500)} | {"a" * n for n in range(5, 40)}
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), shortest, longest, frequent).collect()
    want = {frozenset((a, b)) for a in words for b in words if a < b and _one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(r) for r in got} == want


def test_spelling_slips(spark):
    docs = spark.createDataFrame([(i, "Wörterbuch LETTERS", 1) for i in range(700)], "doc_id long, text string, n long")
    want = Counter()
    for i in range(700):
        for w in ("wörterbuch", "letters"):
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    assert len(want) > 4
    got = spelling.vocabulary(docs, least_times=1).collect()
    assert {r.word: r.n for r in got} == want


def test_variants_of_nothing(spark):
    assert spelling.variants(_empty(spark)).count() == 0
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(_awkward(spark)).collect()}
    assert got == {"letters": (None, "letters", 9, 1, None), "letterz": ("letters", "letters", 3, 1, 9)}


# 12
def _plain_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(marks, bits=2):
    marks, up = sorted(marks), {}
    top = lambda x: x if up.get(x, x) == x else top(up[x])
    for i, a in enumerate(marks):
        for b in marks[i + 1:]:
            if bin(a ^ b).count("1") <= bits:
                up[top(b)] = top(a)
    return {m: top(m) for m in marks}


def test_pigeonring(docs):
    df, _, rows = docs
    marks = [(r[0], _plain_print(r[1])) for r in rows]
    top = _components({m for _, m in marks})
    least = defaultdict(lambda: 10**9)
    for i, m in marks:
        least[top[m]] = min(least[top[m]], i)
    got = pigeonring.linked(df).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{m:016x}", least[top[m]]) for i, m in marks)
    assert sum(r.component_id != r.doc_id for r in got) >= 5


@pytest.mark.parametrize("segments, crowd", [(16, 8), (8, 2), (16, 0), (4, 1000)])
def test_links_join_what_all_pairs_join(spark, segments, crowd):
    """A dense cloud, chains of two bits each, lone fingerprints, and the sign bit."""
    rng = random.Random(segments)
    flip = lambda m, n: m ^ sum(1 << b for b in rng.sample(range(64), n))
    marks = {0, 1 << 63, 2**64 - 1}
    for _ in range(30):
        seed = rng.getrandbits(64)
        marks |= {seed, *(flip(seed, rng.randint(1, 3)) for _ in range(rng.choice((0, 2, 40))))}
        for _ in range(6):
            seed = flip(seed, 2)
            marks.add(seed)
    signed = spark.createDataFrame([(m - 2**64 if m >> 63 else m,) for m in marks], "mark long")
    links = [(r.a % 2**64, r.b % 2**64) for r in pigeonring.links(signed, segments=segments, crowd=crowd).collect()]
    assert all(bin(a ^ b).count("1") <= 2 and a != b for a, b in links)
    want, up = _components(marks), {}
    top = lambda x: x if up.get(x, x) == x else top(up[x])
    for a, b in links:
        up[top(a)] = top(b)
    groups = lambda of: {frozenset(m for m in marks if of(m) == t) for t in map(of, marks)}
    assert groups(top) == groups(want.get)


def test_a_crowd_makes_no_square(spark):
    """2,000 fingerprints with 50 bits in common: links stay in proportion."""
    rng = random.Random(1)
    marks = {(0x1234567890ABC << 12) | rng.getrandbits(12) for _ in range(2000)}
    df = spark.createDataFrame([(m,) for m in marks], "mark long")
    assert pigeonring.links(df).count() <= 65 * len(marks)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\n  漢", max_size=60))
def test_fingerprint(text):
    assert pigeonring.fingerprint(text.encode()) == _plain_print(text)


def test_pigeonring_of_nothing(spark):
    assert pigeonring.linked(_empty(spark)).count() == 0
    got = sorted(((r.doc_id, r.component_id) for r in pigeonring.linked(_awkward(spark)).collect()), key=str)
    assert got == [(1, 1)] + [(None, None)] * 4


# 13
@pytest.mark.parametrize("block", [divergence.BLOCK, 5])
def test_divergence(docs, block):
    _same(divergence.audit(docs[0], block=block), divergence.SQL, docs[1])


def test_divergence_in_parts(docs, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    _same(divergence.audit(docs[0]), divergence.SQL, docs[1])


def test_divergence_of_nothing(spark):
    assert divergence.audit(_empty(spark)).count() == 0
    got = sorted(map(tuple, divergence.audit(_awkward(spark)).collect()))
    assert [(r[0], r[1], r[2], r[3]) for r in got if r[2] == "pair"] == [("en", "", "pair", "a"), ("en", "a", "pair", "")]


def test_divergence_ranks_only_the_top(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(" ".join(words), "en", "a", 1)] * 3 + [("other text", "en", "b", 1)] * 3
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string, rank int")).filter("part = 'term' AND source = 'a'")
    assert got.count() == 200 and got.agg(F.max("item")).first()[0] == sorted(words)[199]
