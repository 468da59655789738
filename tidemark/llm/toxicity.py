"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only document labels are given, so token labels are derived first: a word form or word beginning that
toxic training documents hold far more often than others marks its tokens there as toxic.
The field has two states.  A token without any such feature has the same factors as every other such token, so
a run of them is a power of one 2 x 2 matrix, in closed form; the forward and backward passes step from marked
token to marked token and stay exact.  Feature weights, transitions and bias are all fitted by what these passes expect.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, stash, text_of, within

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features, beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
CACHE = 300_000


def features(word: str) -> list[str]:
    """The lower-cased word and its beginnings."""
    w = word.lower()
    return ["=" + w, *[w[:n] for n in PREFIXES if len(w) > n]]


class ToxicField:
    """Weights of the features, the transition, and the document calibration."""

    def __init__(self, weights: dict[str, float], stay: float, enter: float, bias: float) -> None:
        """stay: log factor of toxic after toxic; enter: of toxic after clean; bias: of a toxic token."""
        self.weights, self.stay, self.enter, self.bias = weights, stay, enter, bias
        self.scale = np.array([-4.0, 2.0, 0.5, 0.0])
        self.longest = max(PREFIXES)
        self._powers()
        self.table: dict[str, float | None] = {}

    def _powers(self) -> None:
        """M ** k / top ** k is p + (low / top) ** k * q for the matrix M of one unmarked token."""
        m = np.array([[1.0, math.exp(self.enter + self.bias)], [1.0, math.exp(self.stay + self.bias)]])
        values, vectors = np.linalg.eig(m)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        back = np.linalg.inv(vectors)
        self.p, self.q = np.outer(vectors[:, 0], back[0]), np.outer(vectors[:, 1], back[1])
        self.ratio, self.top = values[1] / values[0], values[0]

    def emission(self, word: str) -> float | None:
        """Log factor of the toxic state beyond the bias, None for an unmarked token."""
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return sum(found) if found else None

    def marked(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """Number and emission of a text's marked tokens, and the count of all its tokens."""
        words, table = WORD.findall(text), self.table
        try:
            found = [table[w] for w in words]
        except KeyError:
            if len(table) > CACHE:
                table.clear()
            for w in words:
                if w not in table:
                    table[w] = self.emission(w)
            found = [table[w] for w in words]
        return [(i, e) for i, e in enumerate(found) if e is not None], len(words)

    def marginals(self, marked: list[tuple[int, float]], size: int) -> list[float]:
        """Probability of the toxic state at each marked token, by the forward and backward passes."""
        p, q, r = self.p, self.q, self.ratio
        (p00, p01), (p10, p11) = p.tolist()
        (q00, q01), (q10, q11) = q.tolist()
        factors = [math.exp(self.bias + min(e, 30.0)) for _, e in marked]
        e0, e1 = math.exp(self.enter), math.exp(self.stay)
        ahead, a, b, last = [], 1.0, 0.0, -1
        for (i, _), f in zip(marked, factors, strict=True):
            k = r ** (i - last - 1)
            a, b = a * (p00 + k * q00) + b * (p10 + k * q10), a * (p01 + k * q01) + b * (p11 + k * q11)
            a, b = a + b, (a * e0 + b * e1) * f
            a, b = a / (a + b), b / (a + b)
            ahead.append((a, b))
            last = i
        out, a, b, nxt = [0.0] * len(marked), 1.0, 1.0, size
        for j in range(len(marked) - 1, -1, -1):
            i = marked[j][0]
            k = r ** (nxt - i - 1)
            a, b = (p00 + k * q00) * a + (p01 + k * q01) * b, (p10 + k * q10) * a + (p11 + k * q11) * b
            x, y = ahead[j]
            out[j] = y * b / (x * a + y * b)
            f = factors[j]
            a, b = a + e0 * f * b, a + e1 * f * b
            a, b = a / (a + b), b / (a + b)
            nxt = i
        return out

    def aggregate(self, marginals: list[float], size: int) -> np.ndarray:
        """What the document score is made of: the sum and largest of the marginals, and their density."""
        total = sum(marginals)
        return np.array([1.0, total, max(marginals, default=0.0), math.log1p(100 * total / (size + 20))])

    def score(self, marginals: list[float], size: int) -> float:
        z = float(self.scale @ self.aggregate(marginals, size))
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def _lexicon(texts: list[str], labels: list[int], least: int = 4) -> dict[str, float]:
    """Features that toxic documents hold more often, with their log odds per occurrence in toxic documents."""
    docs, hits = (Counter(), Counter()), (Counter(), Counter())
    sizes = [0, 0]
    for text, label in zip(texts, labels, strict=True):
        words = Counter(w.lower() for w in WORD.findall(text))
        own = Counter()
        for w, n in words.items():
            for f in features(w):
                own[f] += n
        docs[label].update(own.keys())
        hits[label].update(own)
        sizes[label] += sum(words.values())
    n0, n1 = max(labels.count(0), 1), max(labels.count(1), 1)
    out = {}
    for f, k in docs[1].items():
        if k < least:
            continue
        here, there = (k + 0.5) / (n1 + 1), (docs[0][f] + 0.5) / (n0 + 1)
        rate = ((hits[1][f] + 0.5) / (sizes[1] + 1)) / ((hits[0][f] + 0.5) / (sizes[0] + 1))
        # far more documents than chance gives: a z-score of the difference of shares
        pool = (k + docs[0][f]) / (n0 + n1)
        z = (k / n1 - docs[0][f] / n0) / math.sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1) + 1e-12)
        if z > 6 and here > 3 * there and rate > 3:
            out[f] = min(math.log(rate), 5.0)
    return out


class _Batch:
    """Marked tokens of many sequences, those of one place in their sequences side by side, so that all sequences take
    each step of a pass together."""

    def __init__(self, tokens: list[tuple[list[tuple[int, list[str]]], int, list[int]]], names: list[str]) -> None:
        number = {f: k for k, f in enumerate(names)}
        order = sorted(range(len(tokens)), key=lambda d: -len(tokens[d][0]))
        self.size = np.array([tokens[d][1] for d in order], float)
        most = len(tokens[order[0]][0]) if order else 0
        counts = np.bincount(np.array([len(t[0]) for t in tokens], int), minlength=most + 1)
        self.width = np.cumsum(counts[::-1])[::-1][1:].tolist()  # sequences with more than j marked tokens
        self.start = np.concatenate(([0], np.cumsum(self.width))).astype(int)
        place, truth, owner, feature = np.zeros(self.start[-1]), np.zeros(self.start[-1]), [], []
        for rank, d in enumerate(order):
            marks, _, states = tokens[d]
            for j, ((i, fs), t) in enumerate(zip(marks, states, strict=True)):
                m = self.start[j] + rank
                place[m], truth[m] = i, t
                owner += [m] * len(fs)
                feature += [number[f] for f in fs]
        self.place, self.truth = place, truth
        self.owner, self.feature = np.array(owner, int), np.array(feature, int)
        # transitions of the given states: tokens without a mark are clean
        self.stays = sum(states[j] and states[j - 1] and marks[j][0] == marks[j - 1][0] + 1 for marks, _, states in tokens for j in range(1, len(marks)))

    def emissions(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.feature], len(self.place))

    def run(self, e: np.ndarray, stay: float, enter: float, bias: float, back: bool = False) -> tuple[float, np.ndarray]:
        """Sum of the log partition functions, and (back) the marginals of the marked tokens."""
        field = ToxicField({}, stay, enter, bias)
        (p00, p01), (p10, p11), (q00, q01), (q10, q11) = *field.p.tolist(), *field.q.tolist()
        ratio, top, e0, e1 = field.ratio, math.log(field.top), math.exp(enter), math.exp(stay)
        f = np.exp(bias + np.minimum(e, 30.0))
        n = len(self.size)
        a, b, last, log = np.ones(n), np.zeros(n), np.full(n, -1.0), np.zeros(n)
        fore = np.zeros((len(f), 2))
        for j, wide in enumerate(self.width):
            at = slice(self.start[j], self.start[j] + wide)
            gap = self.place[at] - last[:wide] - 1
            r = ratio**gap
            x, y = a[:wide], b[:wide]
            x, y = x * (p00 + r * q00) + y * (p10 + r * q10), x * (p01 + r * q01) + y * (p11 + r * q11)
            x, y = x + y, (x * e0 + y * e1) * f[at]
            total = x + y
            a[:wide], b[:wide], last[:wide] = x / total, y / total, self.place[at]
            log[:wide] += np.log(total) + gap * top
            fore[at, 0], fore[at, 1] = a[:wide], b[:wide]
        gap = self.size - last - 1
        r = ratio**gap
        end = a * (p00 + p01 + r * (q00 + q01)) + b * (p10 + p11 + r * (q10 + q11))
        partition = float((log + gap * top + np.log(end)).sum())
        out = np.zeros(len(f))
        if back:
            a, b, nxt = np.ones(n), np.ones(n), self.size.copy()
            for j in range(len(self.width) - 1, -1, -1):
                wide = self.width[j]
                at = slice(self.start[j], self.start[j] + wide)
                r = ratio ** (nxt[:wide] - self.place[at] - 1)
                x, y = a[:wide], b[:wide]
                x, y = (p00 + r * q00) * x + (p01 + r * q01) * y, (p10 + r * q10) * x + (p11 + r * q11) * y
                on = fore[at, 1] * y
                out[at] = on / (fore[at, 0] * x + on)
                x, y = x + e0 * f[at] * y, x + e1 * f[at] * y
                a[:wide], b[:wide], nxt[:wide] = x / (x + y), y / (x + y), self.place[at]
        return partition, out


def fit_chain(tokens: list[tuple[list[tuple[int, list[str]]], int, list[int]]], weights: dict[str, float], start: tuple[float, float, float], rounds: int = 30, step: float = 0.5, pull: float = 0.02) -> tuple[dict[str, float], tuple[float, float, float]]:
    """Feature weights and (stay, enter, bias) that make given token states likely, from the given start.

    tokens: of each sequence its marked tokens (place, features), its length, and the marked tokens' states; all other
    tokens are clean.  A round moves each parameter by its count in the given states less its expected count, over the
    size of both; the forward and backward passes give the expectations, those of stay, enter and bias as derivatives
    of the log partition function.
    """
    names = list(weights)
    batch, w, chain = _Batch(tokens, names), np.array([weights[f] for f in names]), np.array(start, float)
    seen = np.bincount(batch.feature, minlength=len(names))
    given = np.array([batch.stays, batch.truth.sum() - batch.stays, batch.truth.sum()], float)
    tiny = 1e-4
    for _ in range(rounds):
        e = batch.emissions(w)
        _, p = batch.run(e, *chain, back=True)
        gradient = np.bincount(batch.feature, (batch.truth - p)[batch.owner], len(names))
        expected = np.array([(batch.run(e, *(chain + d))[0] - batch.run(e, *(chain - d))[0]) / (2 * tiny) for d in np.eye(3) * tiny])
        w = w + step * (8 * gradient / (seen + 4) - pull * w)
        chain = chain + step * (given - expected) / ((given + expected) / 2 + 4)
    return dict(zip(names, w.tolist(), strict=True)), tuple(chain.tolist())


def fit(texts: list[str], labels: list[int], rounds: int = 30, step: float = 0.5) -> ToxicField:
    """Train on whole documents with labels 0 and 1; without both labels the field marks nothing."""
    lexicon = _lexicon(texts, labels) if {0, 1} <= set(labels) else {}
    field = ToxicField(lexicon, 0.5, 0.0, -5.0)
    data = []
    for text, label in zip(texts, labels, strict=True):
        words = WORD.findall(text)
        marks = [(i, [f for f in features(w) if f in lexicon]) for i, w in enumerate(words)]
        data.append(([(i, f) for i, f in marks if f], len(words), label))
    # weak token labels: in toxic documents the marked tokens with the better part of the evidence
    tokens = [(marks, size, [int(label == 1 and sum(lexicon[f] for f in fs) >= 2.0) for _, fs in marks]) for marks, size, label in data]
    if lexicon:
        field.weights, (field.stay, field.enter, field.bias) = fit_chain(tokens, dict.fromkeys(lexicon, 0.5), (field.stay, field.enter, field.bias), rounds, step)
        field._powers()
    weights = field.weights
    x, y = [], np.array(labels, float)
    for marks, size, _ in data:
        x.append(field.aggregate(field.marginals([(i, sum(weights[f] for f in fs)) for i, fs in marks], size), size))
    if lexicon:
        field.scale = _logistic(np.array(x), y)
    return field


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - pull * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 4000, max_chars: int = 40_000_000) -> ToxicField:
    """Fit the field on about max_docs labelled documents drawn by a hash of the id (all, if fewer), and of these, in
    the order of their ids, on those that fit into max_chars code points; the two bound what reaches the driver.  Of
    several labels of a document the higher counts."""
    small_batches(docs.sparkSession)
    marked = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("label")).where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    count = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_docs / max(count, 1))) + 1)
    base = docs.select(column(id_col).alias("id"), text_of(text_col).alias("text"))
    sample = stash(base.join(F.broadcast(drawn), "id"), "toxic_sample")
    rows = within(sample, "id", "text", max_chars)
    order = sorted((r.id, r.text, r.label) for r in rows.select("id", "text", "label").toLocalIterator())
    texts, given = [r[1] for r in order], [r[2] for r in order]
    return fit(texts, given)


def score_documents(docs: DataFrame, field: ToxicField, id_col: str = "doc_id", text_col: str = "text", span_from: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), spans (array of start, end, probability in code points).

    Null, empty and wordless texts get the score of a document without toxic tokens and no spans.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, spans = [], []
            for item in batch.column("text"):
                text = item.as_py() or ""
                marks, size = model.marked(text)
                p = model.marginals(marks, size)
                scores.append(model.score(p, size))
                high = {i: m for (i, _), m in zip(marks, p, strict=True) if m >= span_from}
                spans.append([{"start": w.start(), "end": w.end(), "p": high[i]} for i, w in enumerate(WORD.finditer(text)) if i in high] if high else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    base = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,p:double>>")
