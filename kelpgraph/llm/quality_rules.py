"""Quality rules on words, lines and symbols, with a suffix-array measure of repetition.

Method. The suffix array of a document's words is built by prefix doubling, in which a suffix that shares no words with
another drops out (nearly all of a clean text does after two rounds). The longest common prefixes of neighbours follow
by halving steps over hashes of ranges. An interval of the array whose neighbours share min_repeat words or more is a
maximal repeated substring: the spans of all are united. The verdict limits the covered fraction and the longest one.

All is within a document: blocks of documents go through NumPy in mapInArrow, with no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _SEP, _T, BYTES, U, WORDS, Block, blocks, cover, mix

#: The symbols that the base rule counts.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeats(block: Block, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths): each place whose suffix shares `least` words or more with another of its document, and the
    most words that it shares with any."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    key = mix(words + block.wdoc.astype(U) * U(0x9E3779B97F4A7C15))  # so that documents share nothing
    active = np.argsort(key, kind="stable")
    rank, width, shared = np.zeros(n, np.int64), 1, None
    key, old = key[active], np.zeros(n, np.int64)
    finish = block.first[1:][block.wdoc]
    while True:
        # rank: where a group of suffixes that share width words begins in the order
        at = np.arange(len(active))
        new = np.append(True, (key[1:] != key[:-1]) | (old[1:] != old[:-1]))
        group = np.maximum.accumulate(np.where(new, at, 0))
        before = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        rank[active] = old + group - before
        size = np.bincount(group, minlength=len(active))
        active = active[size[group] > 1]
        if shared is None and 2 * width > least:
            shared = active
        if not len(active):
            break
        ahead = active + width
        second = np.where(ahead < finish[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = rank[active] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        active, key, old = active[order], second[order], rank[active[order]]
        width *= 2
    if shared is None or not len(shared):
        return none, none
    sa = shared[np.argsort(rank[shared], kind="stable")]
    a, b = sa[:-1], sa[1:]
    limit = np.where(block.wdoc[a] == block.wdoc[b], finish[np.maximum(a, b)] - np.maximum(a, b), 0)
    prefix, length = WORDS.prefix(words), np.zeros(len(a), np.int64)
    step = 1 << max(0, int(limit.max(initial=1)).bit_length() - 1)
    while step:
        fits = np.flatnonzero(length + step <= limit)
        x, y = a[fits] + length[fits], b[fits] + length[fits]
        length[fits[WORDS.between(prefix, x, x + step) == WORDS.between(prefix, y, y + step)]] += step
        step >>= 1
    most = np.maximum(np.append(0, length), np.append(length, 0))
    return sa[most >= least], most[most >= least]


def measure(block: Block, least: int) -> dict[str, np.ndarray]:
    """The base counts of each document, the words covered by repeats and the longest repeat."""
    n, docs = len(block.ws), len(block.start)
    words, doc = block.hashes(), block.wdoc
    prefix = lambda x: np.concatenate(([0], np.cumsum(x)))
    total = lambda x, first: prefix(x)[first[1:]] - prefix(x)[first[:-1]]
    edges = np.append(block.start, len(block.data))
    points = ~_SEP[block.data] & ((block.data & 0xC0) != 0x80)

    # three-word windows that occur twice
    window = np.flatnonzero(np.arange(n) + 3 <= np.repeat(block.first[1:], block.n_words))
    twice = np.zeros(len(window), bool)
    if len(window):
        key = mix(WORDS.between(WORDS.prefix(words), window, window + 3) + doc[window].astype(U) * U(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = np.append(False, key[order][1:] == key[order][:-1])
        twice[order] = same | np.append(same[1:], False)
    repeat = cover(n, window[twice], window[twice] + 3)

    # lines with a word, equal to an earlier one; split at \n alone
    stops = np.flatnonzero(block.data == 10)
    begin = np.unique(np.concatenate((block.start[block.end > block.start], stops + 1)))
    begin = begin[begin < len(block.data)]
    finish = np.minimum(np.append(begin[1:], len(block.data)), np.append(stops, len(block.data))[np.searchsorted(stops, begin)])
    full = np.searchsorted(block.ws, finish) > np.searchsorted(block.ws, begin)
    begin, finish = begin[full], finish[full]
    line_doc = np.searchsorted(block.start, begin, "right") - 1
    line = mix(BYTES.between(BYTES.prefix(_T[block.data]), begin, finish) + line_doc.astype(U) * U(0xC2B2AE3D27D4EB4F))
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[order] = np.append(np.zeros(min(1, len(line)), bool), line[order][1:] == line[order][:-1])

    place, length = repeats(block, words, least)
    covered = cover(n, place, place + length)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc[place], length)
    count = lambda which: np.bincount(which, minlength=docs).astype(np.int64)
    return {
        "n_words": block.n_words.astype(np.int64), "word_chars": total(points, edges), "n_symbols": total(_SYMBOL[block.data], edges),
        "n_dup_lines": count(line_doc[again]), "n_repeat_words": count(doc[repeat]), "covered_words": count(doc[covered]), "longest_repeat": longest,
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def judge(
    documents: DataFrame, *, min_repeat: int = 8, max_covered: float = 0.3, max_longest: int = 150, min_words: int = 50,
    id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """The counts of each document and the verdicts base_failed and kept.

    base_failed: under min_words words, or over half of them in three-word windows that occur twice. kept is false if
    base_failed, if repeated substrings of min_repeat words or more cover over max_covered of the words, or if the
    longest is over max_longest words. Maximal repeats may overlap themselves, as in a run of one word.

    Words of a repeat of min_repeat lie in three-word windows that occur twice, so max_covered says something beside the
    base rule only under its half.

    A row for each input row, in which `keep` names more columns to carry along unchanged (under their names after a
    prefix `in_`, so none can clash). A null or wordless text has all counts 0 and is not kept.
    """
    carry = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                found = measure(block, min_repeat)
                size = block.rows.stop - block.rows.start
                kept = [batch.column(i).slice(block.rows.start, size) for i in range(2, 2 + len(carry))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.rows.start, size), *(pa.array(found[c], pa.int64()) for c in COUNTS), *kept],
                    names=["doc_id", *COUNTS, *(f"in_{c}" for c in carry)],
                )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"in_{c}") for c in carry))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"`in_{c}` {types[f'in_{c}']}" for c in carry)])
    out = rows.mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bad = (F.col("covered_words") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest)
    out = out.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & ~bad).alias("kept"), *COUNTS[5:], *(f"in_{c}" for c in carry))
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
