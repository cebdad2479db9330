"""Language of a text by bit-sliced Bloom filters over its n-grams.

Method. One table of rows holds for every slot a bitmask of languages: the bit-sliced Bloom filters of all languages.
An n-gram reads its rows and the bitwise and of their masks are the languages that contain it. The bits are counted for
eight languages in one addition, over all n-grams of the text, and the counts corrected for false positives: with a share f of a language's filter filled
and k hashes, an n-gram that it lacks is found with probability f**k, so c of n found stand for (c - n f**k) / (1 - f**k).
The largest corrected share decides.

The filters are learned from a bounded sample for each language; an n-gram enters a language's filter if enough of its
sample's documents have it, so quotations in another language don't. The table has 16 KB for each language (in steps of
64 languages) and goes out with the task; scoring reads each whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold
from .tables import save
from .tokens import _FOLD, U, Block, blocks, mix

SLOTS = 1 << 17
HASHES = 2
SIZES = (2, 3)
CELLS = 18  # n-grams are told apart by so many bits of their hash
#: Documents of each language that the filters are learned from, at most (about; by a hash of the id).
SAMPLE = 4_000
#: Languages whose counts a task holds before it gives them out (1 MB each).
HELD = 64
#: A language's n-grams are those in so large a share of its sampled documents.
LEAST_SHARE = 0.01

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True
_LETTER[0x80:0xC0] = True


def ngrams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, cell) of the n-grams of each size, of bytes with A-Z folded, that have letters and spaces only."""
    data = _FOLD[block.data].astype(U)
    letter = _LETTER[block.data]
    space = (block.data == 32) | (block.data == 10)
    good = letter | space
    doc = np.repeat(np.arange(len(block.start)), block.end - block.start)
    bad = np.concatenate(([0], np.cumsum(~good)))
    letters = np.concatenate(([0], np.cumsum(letter)))
    value = data
    for size in range(2, max(SIZES) + 1):
        if len(data) < size:
            return
        value = value[:-1] * U(256) + data[size - 1 :]
        if size in SIZES:
            n = len(value)
            at = np.flatnonzero((bad[size:] == bad[:n]) & (letters[size:] - letters[:n] >= size - 1) & (doc[size - 1 :] == doc[:n]))
            yield doc[at], mix(value[at] + U(size << 56)) >> U(64 - CELLS)


def rows_of(cells: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    hashes = mix(cells * U(0x9E3779B97F4A7C15) + U(1))
    return [((hashes >> U(20 * k)) & U(slots - 1)).astype(np.int64) for k in range(HASHES)]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, documents of it that have the cell), summed over HELD languages' documents or more."""
    counts: dict[str, np.ndarray] = {}

    def held() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            cell = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(c[cell].astype(np.int64))], names=["lang", "cell", "n"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for block in blocks(batch):
            own = langs[block.rows]
            for doc, cells in ngrams(block):
                once = np.unique((doc.astype(U) << U(CELLS)) | cells)
                where, cell = (once >> U(CELLS)).astype(np.int64), (once & U((1 << CELLS) - 1)).astype(np.int64)
                for lang in set(own):
                    mine = np.array([x == lang for x in own])[where]
                    np.add.at(counts.setdefault(lang, np.zeros(1 << CELLS, np.uint32)), cell[mine], 1)
                    if len(counts) >= HELD:
                        yield from held()
                        counts.clear()
    yield from held()


#: Of a byte its eight bits, each in a byte of its own.
_SPREAD = (((np.arange(256, dtype=U)[:, None] >> np.arange(8, dtype=U)) & U(1)) << (np.arange(8, dtype=U) * U(8))).sum(axis=1, dtype=U)


def popcounts(mask: np.ndarray, doc: np.ndarray, docs: int, languages: int) -> np.ndarray:
    """How often each language's bit is set in the masks (rows x words of 64 languages) of each document, docs x languages."""
    width = -(-languages // 8)
    out = np.zeros((docs, width * 8), np.int64)
    if not len(mask) or not width:
        return out[:, :languages]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    cuts = np.union1d(first, np.arange(0, len(mask), 255))  # so many ones fit a byte
    octets = np.ascontiguousarray(mask).view(np.uint8).reshape(len(mask), -1)
    for k in range(width):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], cuts)
        np.add.at(out, (doc[cuts][:, None], np.arange(8 * k, 8 * k + 8)), sums.view(np.uint8).reshape(-1, 8))
    return out[:, :languages]


class Filters:
    """The bit-sliced filters: table has for each slot one 64-bit mask for every 64 languages."""

    def __init__(self, langs: list[str], slots: int = SLOTS) -> None:
        self.langs, self.slots = langs, slots
        self.table = np.zeros((slots, max(1, -(-len(langs) // 64))), U)

    def add(self, language: int, cells: np.ndarray) -> None:
        for rows in rows_of(cells, self.slots):
            self.table[rows, language // 64] |= U(1 << (language % 64))

    def filled(self) -> np.ndarray:
        return np.array([((self.table[:, k // 64] >> U(k % 64)) & U(1)).mean() for k in range(len(self.langs))])

    def decide(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(language, score): the index of the language of the largest corrected count, and its share of their sum."""
        docs = len(block.start)
        number, found = np.zeros(docs), np.zeros((docs, len(self.langs)))
        for doc, cells in ngrams(block):
            number += np.bincount(doc, minlength=docs)
            mask = None
            for rows in rows_of(cells, self.slots):
                mask = self.table[rows] if mask is None else mask & self.table[rows]
            found += popcounts(mask, doc, docs, len(self.langs))
        wrong = np.minimum(self.filled() ** HASHES, 0.999)
        right = np.maximum((found - number[:, None] * wrong) / (1 - wrong), 0)
        best = right.argmax(axis=1) if len(self.langs) else np.zeros(docs, np.int64)
        total = right.sum(axis=1)
        top = right[np.arange(docs), best] if len(self.langs) else np.zeros(docs)
        return best, np.where(total > 0, top / np.where(total > 0, total, 1), 0.0)


def learn(labelled: DataFrame, *, sample: int = SAMPLE, least_share: float = LEAST_SHARE) -> Filters:
    """Filters from rows of doc_id, text and lang (both not null), about `sample` documents of each language.

    A document is an id and a text, however often its row is repeated. What is collected is the languages' names and sizes
    and at most 2**CELLS n-grams of each."""
    rows = {r.lang: r.rows for r in labelled.groupBy("lang").agg(F.approx_count_distinct(F.struct("doc_id", F.xxhash64("text"))).alias("rows")).collect()}
    if not rows:
        return Filters([])
    # a literal map, not a join: the text isn't shuffled by language, of which one may hold most rows
    most = F.create_map(*(F.lit(x) for lang, n in sorted(rows.items()) for x in (lang, int((1 << 30) * min(1, sample / n)))))
    place = F.pmod(F.xxhash64(F.lit(5), F.coalesce("doc_id", F.xxhash64("text"))), 1 << 30)
    chosen = save(labelled.where(place < most[F.col("lang")]).groupBy("lang", "doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text"))
    number = {r.lang: r.rows for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()}
    filters = Filters(sorted(number))
    if number:
        enough = F.create_map(*(F.lit(x) for lang, n in sorted(number.items()) for x in (lang, max(1.0, least_share * n))))
        cells = chosen.repartition(F.xxhash64("text")).mapInArrow(_document_counts, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
        found = cells.where(F.col("n") >= enough[F.col("lang")]).groupBy("lang").agg(F.collect_list("cell").alias("cells"))
        place_of = {lang: k for k, lang in enumerate(filters.langs)}
        for r in found.toLocalIterator():
            filters.add(place_of[r.lang], np.array(r.cells, U))
    return filters


def identify(documents: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each row's id, held_out, lang_pred and score (0 to 1).

    Learned from text and lang of rows whose crc32(id as text) mod 4 is not 2, from about `sample` documents of each
    language, chosen by a hash of the id (of the text, without one); held_out are the others. A text that is
    null or has no letter is `und` with score 0, as is every text if nothing could be learned. A tie goes to the
    language first in order. Short texts without any known n-gram get the first language with score 0.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    filters = learn(docs.where((fold("doc_id", 4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()), sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                best, score = filters.decide(block)
                names = [filters.langs[k] for k in best] if filters.langs else ["und"] * len(best)
                ids = batch.column("doc_id").slice(block.rows.start, len(best))
                yield pa.RecordBatch.from_arrays([ids, batch.column("lettered").slice(block.rows.start, len(best)), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lettered", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, "doc_id long, lettered boolean, lang_pred string, score double")
    known = F.col("lettered")
    return out.select(F.col("doc_id").alias(id_col), (fold("doc_id", 4) == 2).alias("held_out"), F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"))
