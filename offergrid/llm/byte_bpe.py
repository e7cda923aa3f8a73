"""Byte-level BPE encoding and decoding as a tree reduction.

A text is cut in halves down to leaves.  Two neighbours are joined by encoding
a window around their border again and widening it until what lies outside can
not change any more:

* pieces of the splitting pattern: a match depends on at most two characters
  behind its end and on none before its start.  Matching from a piece border of
  the left part that is two characters away from its end gives pieces of the
  whole text, and from the first border that is also one of the right part, the
  right part's own pieces follow.
* tokens inside a piece: a sequence of tokens is the encoding of its bytes if
  and only if every two neighbours are the encoding of theirs.  So the window is
  wide enough once its first token is the left part's own and its last token
  the right part's own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAF_CHARS = 4096
LEAF_BYTES = 24
LEAF_TOKENS = 4096
NEVER = 1 << 60
#: Entries kept in each memo of a worker; a full memo is emptied.
MEMO = 250_000
#: Bytes of text whose ids are held at a time.
PORTION = 2_000_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    """``ranks``: token bytes to id, where a smaller id merges first; ``pattern`` splits the text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS):
        self.ranks, self.match, self.leaf = ranks, regex.compile(pattern).findall, leaf
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._windows: dict[bytes, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        """All matches of the pattern, by halves."""
        if len(text) <= self.leaf:
            return self.match(text)
        half = len(text) // 2
        return self._join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def _join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        tail = ""
        while left and len(tail) < 2:
            tail = left.pop() + tail
        width = 2
        while True:
            window = tail + "".join(right[:width])
            found, whole = self.match(window), width >= len(right)
            if whole:
                return left + found
            borders, at = {len(tail): 0}, len(tail)
            for i, p in enumerate(right[:width], 1):
                at += len(p)
                borders[at] = i
            at = 0
            for i, p in enumerate(found, 1):
                at += len(p)
                if at in borders and at <= len(window) - 2:
                    return left + found[:i] + right[borders[at]:]
            width *= 2

    def _window(self, data: bytes) -> tuple[int, ...]:
        """Encode a window around a border."""
        if len(data) > LEAF_BYTES:
            return self._merge_long(data)
        known = self._windows.get(data)
        if known is None:
            known = self._merge(data)
            if len(self._windows) >= MEMO:
                self._windows.clear()
            self._windows[data] = known
        return known

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """Encode a few bytes by merging the pair of least rank, the leftmost first."""
        rank_of = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = [rank_of(data[i:i + 2], NEVER) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) != NEVER:
            at = ranks.index(least)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], NEVER)
        return tuple([self.ranks[p] for p in parts])

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same for a window that had to grow: candidate pairs wait in a heap, so time is n log n."""
        size, rank_of = len(data), self.ranks.get
        end, before, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := rank_of(data[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, start, stop = heappop(heap)
            middle = end[start]
            if not alive[start] or middle >= size or end[middle] != stop:
                continue  # one of the two has been merged since
            end[start], alive[middle] = stop, False
            if stop < size:
                before[stop] = start
                if (r := rank_of(data[start:end[stop]])) is not None:
                    heappush(heap, (r, start, end[stop]))
            if (prior := before[start]) >= 0 and (r := rank_of(data[prior:stop])) is not None:
                heappush(heap, (r, prior, stop))
        return tuple([self.ranks[data[i:end[i]]] for i in range(size) if alive[i]])

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of ``left`` and ``right`` together."""
        of, i, j = self.bytes_of, 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            w = self._window(b"".join(map(of.__getitem__, left[len(left) - i:] + right[:j])))
            left_holds = i == len(left) or w[0] == left[-i]
            right_holds = j == len(right) or w[-1] == right[j - 1]
            if left_holds and right_holds:
                return left[:len(left) - i] + w + right[j:]
            i, j = (i if left_holds else 2 * i), (j if right_holds else 2 * j)

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Encode one piece: a leaf, or its halves, joined."""
        one = self.ranks.get(data)
        if one is not None:
            return (one,)
        if len(data) <= LEAF_BYTES:
            return self._merge(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_bytes(piece.encode("utf-8", "replace"))
        if len(piece) <= 32:
            self._pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        pieces, known = self.pieces(text), self._pieces
        if len(known) >= MEMO:
            known.clear()
        return list(chain.from_iterable([known.get(p) or self.encode_piece(p) for p in pieces]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: those of the two halves, one after the other."""
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """The codec of a file with a base64 token and its rank in each line; once per worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return ByteBpe(ranks, pattern)


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        decimal = [str(i) for i in range(max(codec.bytes_of) + 1)]
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                coded.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs`` (doc_id, text).

    A null text is empty and has no tokens.  Rows are coded where they are read:
    no shuffle, one batch in memory.  Repeated rows give equal rows, other
    columns are ignored, an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_digests(path, pattern), SCHEMA)


def _portions(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``PORTION`` bytes of text in column ``texts``, so ids of few texts are held at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > PORTION:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def _id_lists(codec: ByteBpe, texts: pa.Array) -> pa.ListArray:
    """Token ids of every text as one Arrow list column; a text's Python ids are gone before the next one's come."""
    parts, ends = [], [0]
    for text in texts:
        parts.append(np.array(codec.encode(text.as_py() or ""), np.int32))
        ends.append(ends[-1] + len(parts[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def _ids(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in _portions(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, _id_lists(codec, part.column(at))],
                                                 names=[*batch.schema.names, "token_ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with a column ``token_ids``; a column of that name is replaced."""
    docs = docs.drop("token_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_ids(path, pattern), schema)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, round_trip (whether the decoded bytes are the text's) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            for part in _portions(batch, 2):
                ids = _id_lists(codec, part.column(2))
                same = [codec.decode(i.values.to_numpy().tolist()) == (t.as_py() or "").encode("utf-8", "replace")
                        for i, t in zip(ids, part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pc.cast(pc.list_value_length(ids), pa.int64()), ids,
                                                  pa.array(same, pa.bool_())],
                                                 names=["doc_id", "source", "n_tokens", "token_ids", "round_trip"])

    return docs.select("doc_id", "source", "text").mapInArrow(
        run, "doc_id long, source string, n_tokens long, token_ids array<int>, round_trip boolean")


def _texts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("token_ids")
            texts = [codec.decode(ids.as_py() or []).decode("utf-8", "replace") for ids in batch.column(at)]
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(texts, pa.string())],
                                             names=[*[batch.schema.names[i] for i in keep], "text"])

    return run


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``coded`` with ``token_ids`` turned back into a column ``text``."""
    coded = coded.drop("text")
    rest = [f for f in coded.schema.fields if f.name != "token_ids"]
    schema = T.StructType([*rest, T.StructField("text", T.StringType())])
    return coded.mapInArrow(_texts(path, pattern), schema)
