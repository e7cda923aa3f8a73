"""Personal data: fixed rules, and a character BiLSTM with CRF transitions that adds spans.

The CRF has one hard rule: a span holds a digit or an ``@``.  So windows are
laid only around such characters; every other window would decode to nothing
whatever its scores.  Windows overlap; each character takes its tag from the
window in whose middle it lies most, and spans are read from the joined tags.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import settle

KINDS = ("email", "ip", "card", "phone")
#: Characters on both sides of a digit or @ that are read; window length and step; windows the model is fitted on.
AROUND, WINDOW, STEP = 20, 96, 56
FIT_SPANS, FIT_OTHER = 1_000, 500
HIDDEN, STEPS, BATCH = 16, 450, 48
SYMBOLS, TAGS = 131, 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starting only where no digit stands before finds the same matches without trying every digit of a long run
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the rules, sorted."""
    if not _ANCHOR.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


def windows(text: str) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows around digits and @."""
    areas: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.start() + AROUND + 1)
        if areas and a <= areas[-1][1]:
            areas[-1][1] = b
        else:
            areas.append([a, b])
    out = []
    for a, b in areas:
        while b - a > WINDOW:
            out.append((a, a + WINDOW))
            a += STEP
        out.append((a, b))
    return out


def symbols(text: str) -> np.ndarray:
    """A number for every character: ASCII as it is, others by kind."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    other = np.flatnonzero(codes >= 128)
    codes[other] = [128 if text[i].isalpha() else 129 if text[i].isdigit() else 130 for i in other]
    return codes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


class Tagger:
    """Two LSTMs over one-hot characters, a linear layer, and CRF transitions; all in numpy."""

    def __init__(self, seed: int = 3):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.p = {}
        for side in "fb":
            self.p["x" + side] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
            self.p["x" + side][:, h:2 * h] += 1.0  # forget gates start open
            self.p["h" + side] = rng.normal(0, h**-0.5, (h, 4 * h))
        self.p |= {"out": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "begin": np.zeros(TAGS)}
        self.barred = np.zeros((TAGS, TAGS))
        self.barred_start = np.zeros(TAGS)
        for inside in range(2, TAGS, 2):  # tag 2k+1 begins kind k, 2k+2 goes on inside it
            self.barred[[t for t in range(TAGS) if t not in (inside, inside - 1)], inside] = -1e4
            self.barred_start[inside] = -1e4

    def _side(self, ids: np.ndarray, mask: np.ndarray, side: str):
        b, t, h = *ids.shape, HIDDEN
        hs, cs, gates = np.zeros((t + 1, b, h)), np.zeros((t + 1, b, h)), np.empty((t, b, 4 * h))
        x, u = self.p["x" + side], self.p["h" + side]
        for i in range(t):
            g = x[ids[:, i]] + hs[i] @ u
            g[:, :3 * h] = _sigmoid(g[:, :3 * h])
            g[:, 3 * h:] = np.tanh(g[:, 3 * h:])
            on = mask[:, i, None]
            cs[i + 1] = (g[:, h:2 * h] * cs[i] + g[:, :h] * g[:, 3 * h:]) * on
            hs[i + 1] = g[:, 2 * h:3 * h] * np.tanh(cs[i + 1]) * on
            gates[i] = g
        return hs, cs, gates

    def emissions(self, ids: np.ndarray, mask: np.ndarray):
        forth = self._side(ids, mask, "f")
        back = self._side(ids[:, ::-1], mask[:, ::-1], "b")
        states = np.concatenate([forth[0][1:], back[0][1:][::-1]], axis=2).transpose(1, 0, 2)
        return states @ self.p["out"] + self.p["bias"], states, forth, back

    def _side_grad(self, ids, mask, side, run, dh_all, grad):
        hs, cs, gates = run
        b, t, h = *ids.shape, HIDDEN
        u, dh, dc = self.p["h" + side], np.zeros((b, h)), np.zeros((b, h))
        for i in range(t - 1, -1, -1):
            g, on = gates[i], mask[:, i, None]
            dh = (dh + dh_all[:, i]) * on
            tc = np.tanh(cs[i + 1])
            dc = (dc + dh * g[:, 2 * h:3 * h] * (1 - tc * tc)) * on
            d = np.empty_like(g)
            d[:, :h] = dc * g[:, 3 * h:] * g[:, :h] * (1 - g[:, :h])
            d[:, h:2 * h] = dc * cs[i] * g[:, h:2 * h] * (1 - g[:, h:2 * h])
            d[:, 2 * h:3 * h] = dh * tc * g[:, 2 * h:3 * h] * (1 - g[:, 2 * h:3 * h])
            d[:, 3 * h:] = dc * g[:, :h] * (1 - g[:, 3 * h:] ** 2)
            np.add.at(grad["x" + side], ids[:, i], d)
            grad["h" + side] += hs[i].T @ d
            dc = dc * g[:, h:2 * h]
            dh = d @ u.T

    def loss_and_grad(self, ids, mask, tags):
        """Mean negative log likelihood of ``tags`` and its gradient."""
        e, states, forth, back = self.emissions(ids, mask)
        b, t = ids.shape
        move, begin = self.p["move"] + self.barred, self.p["begin"] + self.barred_start
        alpha, beta = np.empty((t, b, TAGS)), np.zeros((t, b, TAGS))
        alpha[0] = begin + e[:, 0]
        for i in range(1, t):
            new = _logsum(alpha[i - 1][:, :, None] + move, 1) + e[:, i]
            alpha[i] = np.where(mask[:, i, None] > 0, new, alpha[i - 1])
        for i in range(t - 2, -1, -1):
            new = _logsum(move + (e[:, i + 1] + beta[i + 1])[:, None, :], 2)
            beta[i] = np.where(mask[:, i + 1, None] > 0, new, 0.0)
        z = _logsum(alpha[-1], 1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(alpha + beta - z[:, None]).transpose(1, 0, 2) * mask[:, :, None]
        rows, cols = np.nonzero(mask)
        de[rows, cols, tags[rows, cols]] -= 1.0
        grad["begin"] = de[:, 0].sum(0)
        gold = (e[rows, cols, tags[rows, cols]].sum() + begin[tags[:, 0]].sum())
        for i in range(1, t):
            on = mask[:, i] > 0
            if not on.any():
                break
            pair = np.exp(alpha[i - 1][on][:, :, None] + move + (e[on, i] + beta[i][on])[:, None, :] - z[on][:, None, None])
            grad["move"] += pair.sum(0)
            np.add.at(grad["move"], (tags[on, i - 1], tags[on, i]), -1.0)
            gold += move[tags[on, i - 1], tags[on, i]].sum()
        grad["out"] = np.einsum("bth,btk->hk", states, de)
        grad["bias"] = de.sum((0, 1))
        ds = de @ self.p["out"].T
        self._side_grad(ids, mask, "f", forth, ds[:, :, :HIDDEN], grad)
        self._side_grad(ids[:, ::-1], mask[:, ::-1], "b", back, ds[:, ::-1, HIDDEN:], grad)
        return (z.sum() - gold) / b, {k: v / b for k, v in grad.items()}

    def decode(self, texts: list[str]) -> list[np.ndarray]:
        """Best tags of every text."""
        if not texts:
            return []
        ids, mask = _padded([symbols(t) for t in texts])
        e = self.emissions(ids, mask)[0]
        b, t = ids.shape
        move, best = self.p["move"] + self.barred, self.p["begin"] + self.barred_start + e[:, 0]
        came = np.zeros((t, b, TAGS), np.int8)
        for i in range(1, t):
            ways = best[:, :, None] + move
            came[i] = ways.argmax(1)
            on = mask[:, i] > 0
            best = np.where(on[:, None], ways.max(1) + e[:, i], best)
            came[i][~on] = np.arange(TAGS)
        tag, out = best.argmax(1), np.zeros((b, t), np.int64)
        for i in range(t - 1, -1, -1):
            out[:, i] = tag
            tag = came[i][np.arange(b), tag]
        return [out[i, :len(x)] for i, x in enumerate(texts)]

    def train(self, texts: list[str], tags: list[np.ndarray], steps: int = STEPS, seed: int = 5) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        coded, step, loss = [symbols(t) for t in texts], 0, 0.0
        epochs = -(-steps // -(-len(texts) // BATCH))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                ids, mask = _padded([coded[i] for i in rows])
                gold, _ = _padded([tags[i] for i in rows])
                loss, grad = self.loss_and_grad(ids, mask, gold)
                norm = sum(float((g * g).sum()) for g in grad.values()) ** 0.5
                step += 1
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= 0.02 * (1 - 0.8 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, rows))
    out, mask = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)], mask[i, :len(r)] = r, 1.0
    return out, mask


def tags_of(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 * kind + 2
            tags[a] = 2 * kind + 1
    return tags


def variants(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, np.ndarray] | None:
    """The window with a number written another way than the rules take, still marked."""
    some = [s for s in spans if s[0] in (2, 3)]
    if not some:
        return None
    kind, a, b = some[int(rng.integers(len(some)))]
    digits = [c for c in text[a:b] if c.isdigit()]
    digits = [str(rng.integers(10)) if rng.random() < 0.5 else c for c in digits]
    if kind == 2:
        sep = (" ", "-", ".")[int(rng.integers(3))]
        new = sep.join("".join(digits[i:i + 4]) for i in range(0, len(digits), 4))
    else:
        local, sep = "".join(digits[-10:]), ("-", ".", " ")[int(rng.integers(3))]
        new = (f"({local[:3]}) {local[3:6]}{sep}{local[6:]}", f"{local[:3]}{sep}{local[3:6]}{sep}{local[6:]}")[int(rng.integers(2))]
    other = [(k, x, y) for k, x, y in spans if y <= a] + [(k, x + len(new) - (b - a), y + len(new) - (b - a)) for k, x, y in spans if x >= b]
    fresh = text[:a] + new + text[b:]
    return fresh, tags_of(fresh, [(kind, a, a + len(new)), *other])


def fit(texts: list[str], seed: int = 11) -> Tagger | None:
    """Train on windows marked by the rules, and on rewritten ones; None if there are too few."""
    texts, rng = sorted(set(texts)), np.random.default_rng(seed)
    marked = [(t, base_spans(t)) for t in texts]
    if sum(bool(s) for _, s in marked) < 20:
        return None
    rows = [(t, tags_of(t, s)) for t, s in marked]
    rows += [v for t, s in marked if rng.random() < 0.5 and (v := variants(t, s, rng))]
    tagger = Tagger()
    tagger.train([t for t, _ in rows], [g for _, g in rows])
    return tagger


def _plausible(kind: int, part: str) -> bool:
    digits = len(_DIGIT.findall(part))
    if kind == 0:
        return 0 < part.find("@") < len(part) - 1
    return (4 <= digits <= 12 and part.count(".") == 3) if kind == 1 else 12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def added_spans(text: str, spots: list[tuple[int, int]], tags: list[np.ndarray], base: list[tuple[int, int, int]]):
    """Spans of the joined tags of all windows that touch none of the rules' spans."""
    best: dict[int, tuple[float, int]] = {}
    for (a, b), row in zip(spots, tags, strict=True):
        middle = (a + b - 1) / 2
        for i, tag in enumerate(row.tolist(), a):
            far = abs(i - middle)
            if i not in best or far < best[i][0]:
                best[i] = (far, tag)
    out, taken, open_span = [], [(a, b) for _, a, b in base], None
    for i in [*sorted(best), -1]:
        tag = best[i][1] if i >= 0 else 0
        goes_on = open_span and tag == 2 * open_span[0] + 2 and i == open_span[2]
        if open_span and not goes_on:
            kind, a, b = open_span
            if _ANCHOR.search(text, a, b) and _plausible(kind, text[a:b]) and all(b <= x or y <= a for x, y in taken):
                out.append((kind, a, b))
            open_span = None
        if goes_on:
            open_span = (open_span[0], open_span[1], i + 1)
        elif tag % 2 == 1:
            open_span = (tag // 2, i, i + 1)
    return out


@lru_cache(maxsize=1)
def _shared(tagger_bytes: bytes) -> Tagger:
    return pickle.loads(tagger_bytes)


def _found(tagger_bytes: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _shared(tagger_bytes) if tagger_bytes else None
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            bases = [base_spans(t) for t in texts]
            spots = [windows(t) if tagger else [] for t in texts]
            every = [(i, w) for i, ws in enumerate(spots) for w in ws]
            every.sort(key=lambda x: x[1][1] - x[1][0])  # windows of like length together
            tags: dict[tuple, np.ndarray] = {}
            for at in range(0, len(every), 256):
                part = every[at:at + 256]
                for key, row in zip(part, tagger.decode([texts[i][a:b] for i, (a, b) in part]), strict=True):
                    tags[key] = row
            columns: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
            for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
                more = added_spans(text, spots[i], [tags[i, w] for w in spots[i]], base)
                for k, name in enumerate(KINDS):
                    columns[f"n_{name}"].append(sum(s[0] == k for s in base))
                columns["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                columns["spans"].append(_joined(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.string() if k[0] != "n" else pa.int64()) for k, v in columns.items()]],
                names=["doc_id", *columns])

    return run


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0):
            text = text.as_py() or ""
            out += [(text[a:b], bool(base_spans(text[a:b]))) for a, b in windows(text)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.bool_())],
                                         names=["piece", "marked"])


def learn(docs: DataFrame, spans: int = FIT_SPANS, other: int = FIT_OTHER) -> Tagger | None:
    """Fit on at most ``spans`` windows in which the rules find something and ``other`` in which they don't, by least hash."""
    pieces = docs.select("text").mapInArrow(_cut, "piece string, marked boolean")
    # one pass over the texts: windows by class and least hash, at most spans of each
    pieces = pieces.groupBy("marked", "piece").count().drop("count")
    ordered = pieces.withColumn("key", F.xxhash64("piece"))
    texts = []
    ordered = settle(ordered, "windows")
    for flag, bound in ((True, spans), (False, other)):
        texts += [r["piece"] for r in ordered.filter(F.col("marked") == flag).orderBy("key", "piece").limit(bound).collect()]
    return fit(texts)


def find(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs`` (doc_id, text).

    Counts and ``base_sha256`` are of what the rules find; ``spans`` adds what
    only the model finds, where it touches none of theirs.  A null text is
    empty; repeated rows give equal rows; other columns are ignored; an empty
    table gives no rows.  With fewer than 20 windows to learn from (of ``known``,
    else of ``docs``) nothing is added.
    """
    tagger = learn(docs if known is None else known)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_found(pickle.dumps(tagger) if tagger else None), schema)
