"""A quality score learned from trusted positives and unlabelled text.

Method. Non-negative positive-unlabelled risk: with class prior p, logistic loss l and scorer g, the risk is
p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]); where the second part falls below zero, the step goes up its
gradient instead, so that the scorer doesn't learn unlabelled positives as negatives.

The prior and the cut come from margins that cross-fitted scorers give to all unlabelled text, counted on a grid. Prior:
for scorers of positive against unlabelled, the least ratio of unlabelled to positive mass above a margin bounds the
share of positives among the unlabelled. Cut: with that prior the two masses give both error rates at any margin; the
score is 0.5 where their sum is least.

The scorer is additive in binned measures of a text's style (shares of capitals, symbols, digits, repeated words and
lines, lengths), so it has a few hundred weights and goes to the executors with the task. Each text is read once; what
follows reads its 20 measures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold, thinned
from .tables import drop, save
from .tokens import _SEP, U, WORDS, Block, blocks, mix

#: Trusted positives that the fit takes at most (about), and half as many as the unlabelled rows that it takes; the prior
#: and the cut are from all unlabelled rows.
SAMPLE = 20_000
BINS = 16
#: Margins are counted in so many cells from -GRID to GRID.
CELLS, GRID = 2_000, 20.0


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_DIGIT = _class(b"0123456789")
_SYMBOLS = _class(b"#*$%&|<>{}[]\\^~_=+@")
_MARKS = _class(b"!?")
_STOPS = _class(b".,;:'\"()-")


def style(block: Block) -> np.ndarray:
    """Measures of each document, docs x features."""
    docs, data = len(block.start), block.data
    edges = np.append(block.start, len(data))
    size = np.maximum(np.diff(edges), 1)
    words, doc, n = block.hashes(fold=True), block.wdoc, np.maximum(block.n_words, 1)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[edges[1:]] - total[edges[:-1]]

    def distinct(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each document, and how often its commonest occurs."""
        if not len(key):
            return np.zeros(docs), np.zeros(docs)
        order = np.argsort(mix(key + of.astype(U) * U(0x9E3779B97F4A7C15)), kind="stable")
        key, of = key[order], of[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
        times = np.diff(np.append(new, len(key)))
        most = np.zeros(docs, np.int64)
        np.maximum.at(most, of[new], times)
        return np.bincount(of[new], minlength=docs), most

    place = np.flatnonzero(np.arange(len(words)) + 3 <= np.repeat(block.first[1:], block.n_words))
    triples = np.maximum(np.bincount(doc[place], minlength=docs), 1)
    kinds, most = distinct(words, doc)
    kinds3, most3 = distinct(WORDS.between(WORDS.prefix(words), place, place + 3), doc[place])
    length = (block.we - block.ws).astype(float)
    mean = np.bincount(doc, length, docs) / n
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, docs) / n - mean**2, 0))
    first = data[block.ws] if len(words) else np.zeros(0, np.uint8)
    last = data[block.we - 1] if len(words) else first
    words_with = lambda flags: np.bincount(doc, flags, docs) / n
    lines = per_doc(data == 10) + 1
    return np.stack(
        [
            np.log1p(block.n_words), mean, spread, per_doc(_UPPER[data]) / size, per_doc(_DIGIT[data]) / size, per_doc(_SYMBOLS[data]) / size,
            per_doc(_MARKS[data]) / size, per_doc(_STOPS[data]) / size, per_doc(data >= 128) / size, per_doc(_SEP[data]) / size, n / lines,
            kinds / n, most / n, kinds3 / triples, most3 / triples, words_with(_UPPER[first]), words_with(_SYMBOLS[last]), words_with(_MARKS[last]),
            words_with(length > 20), words_with((length == 1) & _SYMBOLS[first]),
        ],
        axis=1,
    )


@dataclass
class Model:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[np.arange(bins.shape[1]), bins].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _descend(model: Model, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, rate: float = 0.05, decay: float = 1e-3) -> None:
    """Adam on the non-negative risk; prior None: plain logistic regression of positive against unlabelled."""
    features, width = model.weights.shape
    cell = np.arange(features) * width
    flat = [x + cell for x in (positive, unlabelled)]
    theta = np.append(model.weights.ravel(), model.bias)
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def gradient(which: int, slope: np.ndarray) -> np.ndarray:
        out = np.bincount(flat[which].ravel(), np.repeat(slope, features), features * width)
        return np.append(out, slope.sum()) / len(slope)

    for step in range(1, steps + 1):
        gp, gu = (theta[:-1][x].sum(axis=1) + theta[-1] for x in flat)
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        if prior is None:
            grad = gradient(0, sp - 1) + gradient(1, su)
        else:
            rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            away = gradient(1, su) - prior * gradient(0, sp)
            grad = prior * gradient(0, sp - 1) + away if rest >= 0 else -away
        grad = grad + decay * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = theta[:-1].reshape(features, width), float(theta[-1])


def _blank(rows: np.ndarray, features: int = 20) -> Model:
    edges = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(rows) else np.zeros((features, BINS - 1))
    return Model(np.ascontiguousarray(edges), np.zeros((features, BINS)), 0.0, 0.5)


def _cells(margin: np.ndarray) -> np.ndarray:
    return np.clip(((margin + GRID) * (CELLS / (2 * GRID))).astype(np.int64), 0, CELLS - 1)


def _above(counts: np.ndarray) -> np.ndarray:
    """The share of the mass in each cell and those over it."""
    return np.cumsum(counts[::-1])[::-1] / max(1, counts.sum())


def prior_of(trusted: np.ndarray, others: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass above a margin that half of the positives reach."""
    p, u = _above(trusted), _above(others)
    return float(np.clip((u[p >= 0.5] / p[p >= 0.5]).min(initial=1.0), 0.05, 0.95))


def cut_of(trusted: np.ndarray, others: np.ndarray, prior: float) -> float:
    """The margin at which the share of positives below and the estimated share of negatives above have the least sum."""
    p, u = _above(trusted), _above(others)
    error = (1 - p) + np.maximum(u - prior * p, 0) / (1 - prior)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 * (2 * GRID / CELLS) - GRID)


def _measured(frame: DataFrame) -> DataFrame:
    """doc_id and x, the measures of its text as 4-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                rows = [x.tobytes() for x in style(block).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.rows.start, len(rows)), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    return frame.mapInArrow(run, "doc_id long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), 20).astype(float)


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """half and measures of rows of a bounded sample, in an order of their own."""
    found = sorted((r.half, bytes(r.x)) for r in rows.select("half", "x").collect())
    return np.array([h for h, _ in found], int), np.array([np.frombuffer(x, np.float32) for _, x in found], float).reshape(len(found), 20)


def _counted(rows: DataFrame, models: list[Model]) -> np.ndarray:
    """How many rows have their margin in each cell, each by the model that hasn't seen its half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            counts += _seen(batch.column("half").to_numpy(), _matrix(batch.column("x")), models)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    for r in rows.select("half", "x").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def _seen(half: np.ndarray, x: np.ndarray, models: list[Model]) -> np.ndarray:
    out = np.zeros(CELLS, np.int64)
    for k, model in enumerate(models):
        out += np.bincount(_cells(model.margin(model.bins(x[half != k]))), minlength=CELLS)
    return out


def fit(positive: DataFrame, unlabelled: DataFrame, sample: int, steps: int = 300) -> Model:
    """A model of rows of half (0 or 1) and x. Without positives or unlabelled rows: the score is 0.5.

    positive: a bounded sample. Of unlabelled a sample is fitted, and all rows are counted for prior and cut."""
    half, p = _collected(positive)
    number = unlabelled.count()
    some = unlabelled if number <= 2 * sample else unlabelled.where(F.pmod(F.xxhash64(F.lit(2), "doc_id", "x"), 1 << 30) < int((1 << 30) * 2 * sample / number))
    other, u = _collected(some)
    model = _blank(np.concatenate((p, u)))
    if not len(p) or not len(u):
        return model
    pb, ub = model.bins(p), model.bins(u)

    def halves(prior: float | None) -> list[Model]:
        out = []
        for k in (0, 1):
            own = Model(model.edges, np.zeros_like(model.weights), 0.0, 0.5)
            mine, rest = pb[half == k], ub[other == k]
            _descend(own, mine if len(mine) else pb, rest if len(rest) else ub, prior, steps if prior else steps // 3)
            out.append(own)
        return out

    first = halves(None)
    model.prior = prior_of(_seen(half, p, first), _counted(unlabelled, first))
    second = halves(model.prior)
    cut = cut_of(_seen(half, p, second), _counted(unlabelled, second), model.prior)
    _descend(model, pb, ub, model.prior, steps)
    model.bias -= cut
    return model


def classify(documents: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, held_out, score and predicted (score >= 0.5), and prior: the estimated share of good text.

    Labels count only from rows whose crc32(id as text) mod 3 is not 1, and of those only the 1s, as trusted positives;
    unlabelled text is that of such documents without a label. The fit takes about `sample` positives and twice as many
    unlabelled rows at most, chosen by a hash; the prior and the cut are from all unlabelled rows. The score is made from
    the whole text alone. A null or empty text is scored as one without words; a null id is held out or not by the empty
    text's crc32. Rows that repeat get equal scores, and teach once as positives. An empty table gives none.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = save(_measured(docs))
    half = F.pmod(F.xxhash64(F.lit(4), "doc_id", "x"), F.lit(2)).cast("int").alias("half")
    seen = measured.where(fold("doc_id", 3) != 1)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where((fold("doc_id", 3) != 1) & F.col("label").isNotNull())
    good = thinned(marked.where("label = 1").select("doc_id").distinct(), sample, 1)
    positive = save(seen.join(F.broadcast(good), "doc_id").distinct())  # about `sample` ids
    number = positive.count()
    if number > 2 * sample:  # ids of many texts
        positive = positive.where(F.pmod(F.xxhash64(F.lit(1), "doc_id", "x"), 1 << 30) < int((1 << 30) * sample / number))
    known = marked.where("doc_id is not null").select("doc_id").distinct()
    others = seen.where("doc_id is not null").join(known, "doc_id", "left_anti").unionByName(seen.where("doc_id is null"))
    others = save(others.select("doc_id", "x", half))
    model = fit(positive.select("doc_id", "x", half), others, sample)
    drop(positive, others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))), pa.float64())], names=["doc_id", "score"])

    out = measured.mapInArrow(run, "doc_id long, score double")
    return out.select(F.col("doc_id").alias(id_col), (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(model.prior).alias("prior"))
