"""Spelling variants of the words of a corpus by variable-length grams.

Every word gets marks at both sides and is cut into grams of ``SHORTEST`` to
``LONGEST`` characters.  A gram is extended only where it is frequent: the
dictionary is a frequency trie over all pieces of the words; the children of a
node above ``FREQUENT`` stay, but its rarest ones fold back into it as long as
they hold no more than ``FREQUENT`` pieces together.  A word's grams are the
longest dictionary matches from each position that no earlier one covers.

One edit changes few of a word's grams.  With ``e`` a gram's last position, an
edit at ``i`` can change it only if ``e - LONGEST + 1 <= i <= e``, or at ``i = e + 1``
if the dictionary knows a longer form of it.  The largest number of grams that
one edit can reach is the word's affected-gram bound; all others must stand in a
near word too, and with each of them all that lies on its side of the edit.  So of
every word the lists of its rarest ``bound + 1`` grams, told apart by what precedes
the gram or by what follows it, are enough to merge: two near words meet in one.
The marks make sure that no edit reaches all grams of a word of
``LEAST_LENGTH`` letters, so no pair is lost.  Pairs that meet are verified by their
edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offergrid.llm.common import settle

LEAST_LENGTH, LEAST_TIMES, RATIO = 5, 3, 2
SHORTEST, LONGEST, FREQUENT = 2, 4, 200
#: Every so manieth (document, word) loses a letter.
SLIP = 97
#: Words a task counts before it hands its counts on, and characters of a text that are split at once.
HELD_WORDS, LONG_TEXT = 200_000, 4_000_000
OPEN, CLOSE = "\x02", "\x03"
#: A-Z are lower by the time this is used.
RUN = r"[a-zÀ-ÿ]+"


def _word_counts(slip: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = re.compile(RUN), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                low = text.as_py().lower().decode("utf-8")  # of bytes: A-Z only
                words = runs.findall(low) if len(low) < LONG_TEXT else (m.group() for m in runs.finditer(low))
                start = f"{'' if doc_id is None else doc_id}:"
                for word, n in Counter(words).items():
                    mark = zlib.crc32((start + word).encode())
                    if mark % slip == 0:
                        at = mark % len(word)
                        word = word[:at] + word[at + 1:]
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return run


def vocabulary(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """word, n of every word of the whole texts of ``docs`` (doc_id, text) that is long and frequent enough."""
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = body.mapInArrow(_word_counts(slip), "word string, n long")
    return (counts.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_times))


def _marks(longest: int) -> int:
    """Marks at a side: as many that one edit can not reach both the first and the last gram of a word of ``LEAST_LENGTH``."""
    return max(1, longest - LEAST_LENGTH // 2)


def _pieces(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """word, p, piece: what stands from each position on, up to the longest gram."""
    marks = _marks(longest)
    marked = F.concat(F.lit(OPEN * marks), F.col("word"), F.lit(CLOSE * marks))
    starts = F.sequence(F.lit(1), F.least(F.char_length(marked) - (shortest - 1), F.char_length("word") + marks))  # none of closing marks alone
    return words.select("word", F.explode(F.transform(starts, lambda p: F.struct(p.alias("p"), F.substring(marked, p, F.lit(longest)).alias("piece")))).alias("x")).select(
        "word", "x.p", "x.piece")


def gram_dictionary(pieces: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """gram, freq, inner (a longer form is known) of the pruned trie over the counted ``pieces`` (piece, n)."""
    def level(size: int) -> DataFrame:
        return pieces.filter(F.char_length("piece") >= size).groupBy(F.left("piece", F.lit(size)).alias("gram")).agg(F.sum("n").alias("freq"))

    kept = level(shortest)
    found = [kept]
    for size in range(shortest, longest):
        ends = pieces.filter(F.char_length("piece") == size).select(F.col("piece").alias("ended"), F.col("n").alias("end_n"))
        parents = (kept.filter(F.col("freq") > frequent).select(F.col("gram").alias("parent"))
                   .join(ends, F.col("parent") == F.col("ended"), "left").select("parent", F.coalesce("end_n", F.lit(0)).alias("end_n")))
        children = level(size + 1).withColumn("up", F.left("gram", F.lit(size)))
        order = Window.partitionBy("up").orderBy("freq", "gram").rowsBetween(Window.unboundedPreceding, 0)  # at most one row a letter
        kept = (children.join(parents, F.col("up") == F.col("parent"))
                .withColumn("folded", F.col("end_n") + F.sum("freq").over(order)).filter(F.col("folded") > frequent).select("gram", "freq"))
        kept = settle(kept, "grams")
        found.append(kept)
    grams = found[0]
    for more in found[1:]:
        grams = grams.unionByName(more)
    inner = found[1].select(F.left("gram", F.lit(shortest)).alias("of"))
    for size, more in enumerate(found[2:], shortest + 1):
        inner = inner.unionByName(more.select(F.left("gram", F.lit(size)).alias("of")))
    return settle(grams.join(inner.distinct(), F.col("gram") == F.col("of"), "left")
                  .select("gram", "freq", F.col("of").isNotNull().alias("inner")), "dictionary")


def _matches(pieces: DataFrame, grams: DataFrame, shortest: int, longest: int) -> DataFrame:
    """piece, gram, freq, inner: the longest gram that each distinct piece starts with."""
    fronts = pieces.select("piece", F.explode(F.transform(
        F.sequence(F.lit(shortest), F.char_length("piece")), lambda k: F.left("piece", k))).alias("front"))
    return (fronts.join(grams, F.col("front") == F.col("gram"))
            .groupBy("piece").agg(F.max_by(F.struct("gram", "freq", "inner"), F.char_length("gram")).alias("m"))
            .select("piece", "m.gram", "m.freq", "m.inner"))


def _coded(gram: Column, freq: Column, inner: Column, p: Column) -> Column:
    """Position, gram length, inner and frequency (as far as 24 bits tell it) as one number, ordered by position."""
    return (F.shiftleft(p.cast("long"), 28) + F.shiftleft(F.char_length(gram).cast("long"), 25) + F.shiftleft(inner.cast("long"), 24)
            + F.least(freq, F.lit((1 << 24) - 1)))


def rarest(marked: str, codes: list[int], longest: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(grams of a marked word, its affected-gram bound, first and last position of its rarest grams) from the codes by position."""
    chosen, reach = [], 0
    for code in codes:
        p, size = code >> 28, code >> 25 & 7
        end = p + size - 1
        if end > reach:
            chosen.append((code & 0xFFFFFF, marked[p - 1:end], p, end, end + 1 if code >> 24 & 1 and size < longest else end))
            reach = end
    bound = 0
    for k, c in enumerate(chosen):  # ends grow, so what an edit reaches together with k stands shortly before it
        first = c[3] - longest + 1
        bound = max(bound, sum(x[4] >= first for x in chosen[max(0, k - longest - 1):k + 1]))
    chosen.sort()
    last = chosen[min(bound, len(chosen) - 1)][:2]
    return len(chosen), bound, [(c[2], c[3]) for c in chosen if c[:2] <= last]


def _prefixes(longest: int):
    """word and what it shares with a near word that has one of its rarest grams: all up to the gram, or all from the gram on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _marks(longest)
        for batch in batches:
            words, sides = [], []
            for word, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marked = OPEN * marks + word + CLOSE * marks
                for p, end in rarest(marked, places, longest)[2]:
                    if end <= len(marked) - marks:  # else no edit can follow
                        words.append(word)
                        sides.append(marked[:end])
                    if p > marks:
                        words.append(word)
                        sides.append(marked[p - 1:])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(sides, pa.string())], names=["word", "side"])

    return run


def near_pairs(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """a, b: every pair of ``words`` (word; distinct, of ``LEAST_LENGTH`` letters at least) one edit apart, once."""
    pieces = settle(_pieces(words, shortest, longest), "pieces")
    counted = settle(pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "counted")
    grams = gram_dictionary(counted, shortest, longest, frequent)
    found = _matches(counted, grams, shortest, longest).select("piece", "gram", "freq", "inner")
    cut = pieces.join(found, "piece").groupBy("word").agg(
        F.sort_array(F.collect_list(_coded(F.col("gram"), F.col("freq"), F.col("inner"), F.col("p")))).alias("places"))
    size = F.char_length("word")
    # an edit behind a shared gram leaves all up to it alone, an edit before it all from it on; lengths differ by one at most
    lists = settle(cut.mapInArrow(_prefixes(longest), "word string, side string").select(
        "word", F.xxhash64("side", size).alias("key"), F.xxhash64("side", size - 1).alias("shorter")), "lists")
    one = lists.select(F.col("word").alias("a"), F.col("key").alias("k"))
    two = lists.select(F.col("word").alias("b"), F.explode(F.array("key", "shorter")).alias("key"))
    longer = F.char_length("b") - F.char_length("a")
    met = one.join(two, (F.col("k") == F.col("key")) & ((longer == 1) | ((longer == 0) & (F.col("a") < F.col("b"))))
                   & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def _root(words: DataFrame) -> DataFrame:
    """word, root from word, form: pointers jump until none moves; a form is twice as frequent, so chains are short and end."""
    state = settle(words.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("w"), F.col("root").alias("next"))
        after = settle(state.join(ahead, F.col("root") == F.col("w"), "left")
                       .select("word", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        state = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return state


def variants(docs: DataFrame, slip: int = SLIP, ratio: int = RATIO, shortest: int = SHORTEST, longest: int = LONGEST,
             frequent: int = FREQUENT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text).

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) are words, A-Z in lower case; one in
    ``slip`` of a document's words loses a letter, by the CRC-32 of doc_id and
    word.  Words of five letters and three occurrences at least are kept.  Two
    are near if one edit apart; a word's ``form`` is its most frequent near word
    (ties: the smaller one) if it is ``ratio`` times as frequent, and ``root`` ends
    the chain of forms.  A null text has no words, an empty table gives no rows; a
    null doc_id counts as empty before the colon; repeated rows count each; a long
    text is split as a stream; other columns are ignored.
    """
    words = settle(vocabulary(docs, slip), "words")
    pairs = settle(near_pairs(words.select("word"), shortest, longest, frequent), "near")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("w", "near")
    n: Column = F.col("near_n")
    named = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("w").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-n).alias("less"), "near")).alias("best"))
    formed = settle(words.join(named, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best")).select(
        "word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")), "formed")
    return formed.join(_root(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")


#: The same by deletion neighbourhoods.  CRC-32 is the exclusive or of one table entry a byte, by value and distance from the end.
SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM
    (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
), keyed AS MATERIALIZED (
  SELECT doc_id, w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS m FROM runs GROUP BY 1, 2
), step(dist, b, v) AS (
  SELECT 0, b::BIGINT, list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) FROM range(256) t(b)
  UNION ALL SELECT dist + 1, s.b, xor(s.v >> 8, z.v) FROM step s JOIN
    (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(b)) z
    ON z.b = (s.v & 255) WHERE dist < (SELECT coalesce(max(strlen(m)), 4) + 4 FROM keyed)
), bytes AS (
  SELECT DISTINCT m, unnest(range(strlen(m))) AS i FROM keyed
), coded AS (
  SELECT m, strlen(m) AS size, strlen(m) - 1 - i AS dist, ('0x' || substr(hex(encode(m)), 2 * i::INT + 1, 2))::BIGINT AS b FROM bytes
), crc AS (
  SELECT m, xor(xor(bit_xor(t.v), any_value(e.v)), 4294967295) AS h FROM coded JOIN step t USING (dist, b) JOIN
    (SELECT size, bit_xor(v) AS v FROM (SELECT DISTINCT strlen(m) AS size FROM keyed) z JOIN step s
       ON s.b = 255 AND s.dist BETWEEN z.size - 4 AND z.size - 1 GROUP BY size) e USING (size) GROUP BY m
), slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n
  FROM keyed JOIN crc USING (m)
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
  SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, w.word FROM less x JOIN words w ON x.d = w.word
  UNION SELECT w.word, x.word FROM less x JOIN words w ON x.d = w.word
), best AS (
  SELECT a, count(*) AS n_near, min({'m': -n, 'w': b}) AS best FROM near JOIN words ON b = word GROUP BY a
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form,
         CASE WHEN -best.m >= 2 * n THEN -best.m END::BIGINT AS form_n FROM words LEFT JOIN best ON a = word
), chain(word, top, steps) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON f.word = c.top WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(top, steps) AS root FROM chain GROUP BY word) USING (word)
"""
