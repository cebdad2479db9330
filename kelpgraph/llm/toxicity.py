"""A toxicity score that identity terms don't move.

Method. A logistic classifier over words and word beginnings. For labelled documents that mention a group, each identity
term is swapped for the others of its kind, and the squared change of the margin is penalised beside the log loss, so
that neutral mentions of a group neither raise nor lower the score. Features are chosen by how much their document
frequency differs between the labels, in a bounded sample of labelled documents; the identity terms always take part.
They are told apart by 64 bits of the word, so that no other word counts as a mention. A text that mentions no group adds
nothing to the penalty: on such texts the model is a plain logistic one.

The model has a few thousand weights and goes out with the task; scoring reads each whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import distinct_sample, fold, thinned
from .tables import save
from .tokens import _FOLD, _T, BYTES, U, Block, blocks, mix

#: Labelled documents of either label that the fit takes at most (about).
SAMPLE = 6_000
FEATURES = 4_096
PREFIXES = (4, 5, 6, 7, 8)
CUT = 0.7
#: Terms that are swapped for each other.
IDENTITIES = {
    "gender": [
        "woman", "women", "man", "men", "female", "male", "transgender", "nonbinary",
        "frau", "frauen", "mann", "männer", "femme", "femmes", "homme", "hommes", "mujer", "mujeres", "hombre", "hombres",
    ],
    "orientation": [
        "gay", "lesbian", "bisexual", "straight", "queer", "heterosexual",
        "schwul", "lesbisch", "bisexuell", "heterosexuell", "lesbienne", "bisexuel", "hétérosexuel", "lesbiana", "homosexual",
    ],
    "religion": [
        "muslim", "muslims", "jewish", "jews", "christian", "christians", "hindu", "buddhist", "atheist",
        "muslime", "jude", "juden", "christen", "musulman", "musulmans", "juif", "juifs", "chrétien", "chrétiens", "musulmán", "musulmanes", "judío", "judíos", "cristiano", "cristianos",
    ],
    "origin": [
        "black", "white", "asian", "african", "american", "mexican", "european", "immigrant", "immigrants", "refugee", "refugees",
        "asiatisch", "afrikanisch", "amerikanisch", "einwanderer", "flüchtling", "flüchtlinge", "asiatique", "africain", "américain", "immigré", "immigrés", "réfugié", "réfugiés",
        "asiático", "africano", "americano", "inmigrante", "inmigrantes", "refugiado", "refugiados",
    ],
    "ability": ["disabled", "deaf", "blind", "autistic", "behindert", "taub", "autistisch", "handicapé", "sourd", "aveugle", "discapacitado", "sordo", "ciego"],
}

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def occurrences(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of each word, A-Z folded and without marks at its ends, and of its beginnings."""
    data = _FOLD[block.data]
    ws, we, doc = block.ws.copy(), block.we.copy(), block.wdoc
    for _ in range(3):
        ws += (ws < we) & _PUNCT[data[np.minimum(ws, len(data) - 1)]] if len(data) else 0
        we -= (ws < we) & _PUNCT[data[we - 1]] if len(data) else 0
    full = ws < we
    ws, we, doc = ws[full], we[full], doc[full]
    prefix = BYTES.prefix(_T[data])
    keys, docs = [mix(BYTES.between(prefix, ws, we) + U(1))], [doc]
    for size in PREFIXES:
        long = we - ws > size
        keys.append(mix(BYTES.between(prefix, ws[long], ws[long] + size) + U(2)))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(keys)


def _word_keys(word: str) -> list[int]:
    data = word.encode()
    block = Block(slice(0, 1), np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.full(1, len(data)))
    return occurrences(block)[1].tolist()


@dataclass
class Model:
    keys: np.ndarray  # of the features, in order
    weights: np.ndarray
    bias: float

    @cached_property
    def _marked(self) -> np.ndarray:
        """Whether a feature has these first 22 bits; made where it is used, so that only the keys travel."""
        out = np.zeros(1 << 22, bool)
        out[(self.keys >> U(42)).astype(np.int64)] = True
        return out

    def features(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value) of the features that occur; value: log of 1 + occurrences."""
        doc, key = occurrences(block)
        some = self._marked[(key >> U(42)).astype(np.int64)]
        doc, key = doc[some], key[some]
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[where] == key
        both, times = np.unique(doc[same] * len(self.weights) + where[same], return_counts=True)
        return both // len(self.weights), both % len(self.weights), np.log1p(times)

    def score(self, block: Block) -> np.ndarray:
        doc, feature, value = self.features(block)
        margin = self.bias + np.bincount(doc, self.weights[feature] * value, len(block.start))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, documents of label 0, of label 1 that have it), for each block."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for block in blocks(batch, limit=1 << 23):
            doc, key = occurrences(block)
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
            doc, key = doc[new], key[new]
            lead = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            toxic = np.add.reduceat(labels[block.rows][doc], lead) if len(key) else lead
            number = np.diff(np.append(lead, len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(key[lead].view(np.int64)), pa.array(number - toxic, pa.int64()), pa.array(toxic, pa.int64())], names=["key", "clean", "toxic"])


def choose(labelled: DataFrame, number: tuple[int, int], features: int) -> np.ndarray:
    """The keys whose document frequencies differ most between the labels, in standard errors (over 3)."""
    sums = labelled.mapInArrow(_key_counts, "key long, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = {c: (F.col(c) + 0.5) / (n + 1) for c, n in zip(("clean", "toxic"), number, strict=True)}
    error = F.sqrt(rate["clean"] * (1 - rate["clean"]) / (number[0] + 1) + rate["toxic"] * (1 - rate["toxic"]) / (number[1] + 1))
    score = F.abs(rate["toxic"] - rate["clean"]) / error
    best = sums.where("clean + toxic >= 5").select("key", score.alias("score")).where("score > 3").orderBy(F.desc("score"), "key").limit(features)
    return np.array([r.key for r in best.collect()], np.int64).view(U)


def counterfactuals(feature: np.ndarray, value: np.ndarray, kinds: list[list[np.ndarray]], features: int) -> tuple[np.ndarray, int]:
    """The sum of the outer products of all changes of feature values, one for each document, identity term in it and
    term put in its place, and their number. Changes of one swap are multiples of one vector."""
    gram, number = np.zeros((features, features)), 0
    for terms in kinds:
        for k, term in enumerate(terms):
            if not len(term):
                continue
            v = value[feature == term[0]]
            for other in (t for j, t in enumerate(terms) if j != k and len(t)):
                change = np.zeros(features)
                change[other] += 1
                change[term] -= 1
                gram += (v @ v) * np.outer(change, change)
                number += len(v)
    return gram, number


def fit(n: int, label: np.ndarray, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, features: int, touched: np.ndarray, gram: np.ndarray, *, steps: int = 200, swap: float = 10.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias. gram: the mean outer product of the counterfactual changes, over the touched features."""
    theta, first, second = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    for step in range(1, steps + 1):
        margin = theta[-1] + np.bincount(doc, theta[feature] * value, n)
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) * weight
        grad = np.append(np.bincount(feature, slope[doc] * value, features) + decay * theta[:-1], slope.sum())
        grad[touched] += 2 * swap * (gram @ theta[touched])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _cut(margin: np.ndarray, label: np.ndarray) -> float:
    """The margin above which label 1 gives the best F1 on cross-fitted margins."""
    order = np.argsort(-margin)
    hits, taken = np.cumsum(label[order]), np.arange(1, len(order) + 1)
    best = int(np.argmax(2 * hits / (taken + label.sum())))
    after = margin[order][best + 1] if best + 1 < len(order) else margin[order][best] - 1
    return float((margin[order][best] + after) / 2)


def train(labelled: DataFrame, *, features: int = FEATURES, swap: float = 10.0) -> Model:
    """A model of rows of text and label (0 or 1), few enough for one task's memory (see classify)."""
    seen = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (seen.get(0) and seen.get(1)):
        return Model(np.zeros(1, U), np.zeros(1), -4.0)
    chosen = choose(labelled, (seen[0], seen[1]), features)
    terms = {kind: [_word_keys(w) for w in words] for kind, words in IDENTITIES.items()}
    always = np.array(sorted({c for kind in terms.values() for keys in kind for c in keys}), U)
    keys = np.union1d(chosen, always)
    model = Model(keys, np.zeros(len(keys)), 0.0)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                doc, feature, value = model.features(block)
                edge = np.searchsorted(doc, np.arange(len(block.start) + 1))
                rows = [(feature[a:b].astype(np.int32).tobytes(), value[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(block.rows.start, len(rows)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "feature", "value"])

    rows = sorted(labelled.mapInArrow(values, "label int, feature binary, value binary").collect(), key=lambda r: (r.label, r.feature, r.value))
    label = np.array([r.label for r in rows], float)
    found = [np.frombuffer(r.feature, np.int32) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in found])
    feature, value = np.concatenate(found).astype(np.int64), np.concatenate([np.frombuffer(r.value) for r in rows])
    place = np.searchsorted(keys, always)
    touched = np.unique(place)
    kinds = [[np.searchsorted(touched, np.searchsorted(keys, np.array(c, U))) for c in kind] for kind in terms.values()]
    inside = np.isin(feature, touched)
    gram, changes = counterfactuals(np.searchsorted(touched, feature[inside]), value[inside], kinds, len(touched))
    gram /= max(1, changes)
    # margins from models that haven't seen the row place the cut
    margins = np.zeros(len(rows))
    part = np.arange(len(rows)) % 3
    for k in range(3):
        inside, mine = part[doc] != k, np.flatnonzero(part != k)
        new = np.zeros(len(rows), np.int64)
        new[mine] = np.arange(len(mine))
        w, b = fit(len(mine), label[mine], new[doc[inside]], feature[inside], value[inside], len(keys), touched, gram, swap=swap)
        margins[part == k] = (b + np.bincount(doc, w[feature] * value, len(rows)))[part == k]
    w, b = fit(len(rows), label, doc, feature, value, len(keys), touched, gram, swap=swap)
    model.weights, model.bias = w, b - _cut(margins, label) + float(np.log(CUT / (1 - CUT)))
    return model


def classify(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, held_out, score (0 to 1) and predicted (score >= CUT).

    Labels count only from rows whose crc32(id as text) mod 3 is not 1, of either label about `sample` of them at most,
    chosen by a hash of the id; held_out are the others. Rows that repeat teach once; texts of one id are rows each. The score is made from the whole text alone. A null or empty
    text is scored as one without words; without labels of both kinds every score is that of such a text. A null id is
    held out or not by the empty text's crc32. Rows that repeat get equal scores.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where((fold("doc_id", 3) != 1) & F.col("label").isin(0, 1)).dropDuplicates(["doc_id"])
    some = thinned(marked.where("label = 1"), sample, 1).unionByName(thinned(marked.where("label = 0"), sample, 2))
    told = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text"))  # bounded by `sample`, unless an id has many texts
    model = train(save(distinct_sample(save(told), sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                ids = batch.column("doc_id").slice(block.rows.start, len(block.start))
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.score(block))], names=["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select(F.col("doc_id").alias(id_col), (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
