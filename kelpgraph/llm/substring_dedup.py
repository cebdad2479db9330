"""Removal of repeated word windows by recompression.

Method. A recompression round gives every maximal run of one symbol, and every pair of a run of the left half of the
alphabet followed by a run of its right half, one new symbol. Halves and names come from hashes of what a symbol stands
for, so all executors name runs and pairs alike without exchanging a dictionary, and a boundary depends on the symbols
beside it alone: equal passages get equal interior symbols, at every level, wherever they stand.

1. Rounds. The first LOCAL_ROUNDS, in which there are about as many symbols as words, name what is in one task's block of
   documents; each round after them is a step of its own over the table of symbols (document, places, names).
2. High level. The symbol table counts each name of the last round. A name that occurs again reveals a repeat: its
   occurrences, each with the width - 1 words after it (a tile), descend to their words and are compared by a digest of
   those. All windows of a tile that occurs earlier go at once, so long repeats cost a row for each symbol.
3. Low level: each window of the other tiles is anchored at one of the symbols whose parse is fixed by the window alone,
   that of least name; equal windows have equal anchors. Only windows whose anchor occurs twice are left.
4. Those are compared by a digest of their words too, and all but the first of equals removed.

Names of 64 bits only reveal; what is removed was equal in 128 bits of BLAKE2b over the words. Every shuffle carries
names, digests and places, by key with partial aggregation, so that a passage that a third of the documents share is one
row for each task. The text is shuffled once, by document, and read again from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, save
from .tokens import U, WORDS, Block, blocks, cover, lists, mix, ranges

#: Rounds within a task's block, and those that follow over the table of symbols.
LOCAL_ROUNDS, ROUNDS = 8, 4
LOW_ROUNDS = 2


def compress(sym: np.ndarray, edge: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the places where the new symbols start, and their names. edge: symbols that begin a document."""
    n = len(sym)
    right = (mix(sym + U(0x632BE59BD9B4E019 * (level + 1) & (2**64 - 1))) & U(1)).astype(bool)
    same = np.zeros(n, bool)
    same[1:] = (sym[1:] == sym[:-1]) & ~edge[1:]
    glued = same.copy()
    glued[1:] |= ~right[:-1] & right[1:] & ~edge[1:]
    start = np.flatnonzero(~glued)
    run = np.flatnonzero(~same)  # runs; a new symbol is one or two of them
    size = np.diff(np.append(run, n)).astype(U)
    name = np.where(size > 1, mix(sym[run] * U(3) + size * U(0x9E3779B97F4A7C15)), sym[run])
    at = np.searchsorted(run, start)
    two = np.diff(np.append(at, len(run))) > 1
    new = name[at]
    new[two] = mix(new[two] * U(0xFF51AFD7ED558CCD) + name[at[two] + 1] + U(level + 1))
    return start, new


def symbols(block: Block, words: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The words at which the symbols of the last of the rounds start, and their names."""
    start, edge, sym = np.arange(len(words)), np.zeros(len(words), bool), words
    edge[block.first[:-1][block.n_words > 0]] = True
    for level in range(rounds):
        at, sym = compress(sym, edge, level)
        start, edge = start[at], edge[at]
    return start, sym


def another_round(table: DataFrame, level: int) -> DataFrame:
    """The table of symbols after one more round. Its rows are (did, n, at, sym): a document, its number of words, and
    for each symbol the place of its first word and its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, place = lists(batch.column("at"))
            names = lists(batch.column("sym"))[1].to_numpy().view(U)
            first = np.concatenate(([0], np.cumsum(size)))
            edge = np.zeros(len(names), bool)
            edge[first[:-1][size > 0]] = True
            start, sym = compress(names, edge, level)
            yield _symbol_rows(batch.column("did"), batch.column("n"), place.to_numpy()[start], sym, np.searchsorted(start, first))

    return table.mapInArrow(run, table.schema)


def _symbol_rows(did: pa.Array, n: pa.Array, at: np.ndarray, sym: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.ListArray.from_arrays(first.astype(np.int32), x) for x in (pa.array(at.astype(np.int32)), pa.array(sym.view(np.int64)))]
    return pa.RecordBatch.from_arrays([did, n, *arrays], names=["did", "n", "at", "sym"])


def anchors(block: Block, words: np.ndarray, width: int, rounds: int = LOW_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For the window that starts at each word: the name and the place of its anchor (of no use where none fits).

    low, high: the words that fix a symbol's parse, itself and the symbols beside it a round before. A window's anchor is
    the one of least name among the highest round's symbols that the window fixes. The name covers low to high.
    """
    n = len(words)
    edge = np.zeros(n, bool)
    edge[block.first[:-1][block.n_words > 0]] = True
    window, prefix = np.arange(n), WORDS.prefix(words)
    name, place = words.copy(), window.copy()
    low, high, sym = window, window + 1, words
    for level in range(rounds if n else 0):
        at, sym = compress(sym, edge, level)
        last = np.append(at[1:], len(edge)) - 1
        inner = ~edge[at] & ~np.append(edge, True)[last + 1] & (low[at] >= 0)
        inner[inner] &= (low[at[inner] - 1] >= 0) & (low[last[inner] + 1] >= 0)
        low, high, edge = np.where(inner, low[at - 1], -1), high[np.minimum(last + 1, len(edge) - 1)], edge[at]
        left, right = low[inner], high[inner]  # those that a window of their document can fix
        if not len(left):
            break
        value = WORDS.between(prefix, left, right)
        lo, hi = np.searchsorted(left, window), np.searchsorted(right, window + width, "right")
        some = np.flatnonzero(hi > lo)
        if not len(some):
            break
        lo, size = lo[some], (hi - lo)[some]
        step = np.int64(np.log2(size))
        least, best = np.arange(len(left)), np.zeros(len(some), np.int64)
        for k in range(int(step.max()) + 1):
            if k:
                other = np.minimum(np.arange(len(left)) + (1 << k - 1), len(left) - 1)
                least = np.where(value[least[other]] < value[least], least[other], least)
            mine = step == k
            i, j = least[lo[mine]], least[lo[mine] + size[mine] - (1 << k)]
            best[mine] = np.where(value[j] < value[i], j, i)
        name[some], place[some] = mix(value[best] + U(level)), left[best]
    return name, place


def _spans(block: Block, batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the (at, number) lists of a column lie among the block's words."""
    length, values = lists(batch.column(column).slice(block.rows.start, block.rows.stop - block.rows.start))
    base = np.repeat(block.first[:-1], length)
    return base + values.field("at").to_numpy(), values.field("number").to_numpy().astype(np.int64)


def _rows(find: Callable[[Block, pa.RecordBatch], dict], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in find(block, batch).values()], schema=schema)

    return run


def _did(block: Block, batch: pa.RecordBatch, doc: np.ndarray) -> pa.Array:
    return batch.column("did").take(pa.array(doc + block.rows.start))


def _digests(block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of each range [start, end) of words, joined by one space."""
    data, _ = block.joined(np.ones(len(block.ws), bool))
    place = np.concatenate(([0], np.cumsum(block.we - block.ws + 1)))
    view, digest = memoryview(data), hashlib.blake2b
    found = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(place[start].tolist(), (place[end] - 1).tolist(), strict=True)])
    both = np.frombuffer(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def dedup(documents: DataFrame, *, width: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each document without the words covered by a window that occurs earlier.

    A window is `width` consecutive words of one document. Earlier: in a document of smaller id, or in the same one at
    an earlier start; windows are judged on the input. Returns a row for each input row: id, n_words, n_removed,
    kept_sha256 and, if carry is given, kept_text (the kept words joined by one space) and the columns it names, as in_<name>.

    A null or wordless text has no words and gives the hash of the empty string. A null id counts as smaller than all
    others. Identical repeated rows are one document, returned as often as it was given. Rows of one id with different
    texts are told apart by the text (in the order of its hash). Columns that carry doesn't name, whatever their names, are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"in_{c}") for c in carry or [] if c != text_col))
    carried, given = [f"in_{c}" for c in carry or []], {f"in_{text_col}": "text"}  # the text itself travels once
    travels = [c for c in carried if c not in given]
    low, high, size, rows, ids = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    bits = max(1, ((size or 0) // 2 + 1).bit_length())
    packs = rows == ids and (0 if high is None else high - low).bit_length() + bits <= 62
    if packs:  # id and place in one number: cheap to aggregate
        did, kind = F.coalesce(F.col("doc_id") - F.lit(low or 0), F.lit(0)), pa.int64()  # never null: else some reads of the exchange below get a filter and one of their own
    else:
        did, kind = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text")), pa.struct([("id", pa.int64()), ("text", pa.int64())])
    docs = source = docs.select(did.alias("did"), "text", *travels)
    if packs:
        unique = docs = docs.repartition("did")  # one exchange, read by each of the passes
    else:  # equal rows are one until the end
        travels, carried = [*travels, "times"], [*carried, "times"]
        docs = docs.groupBy("did", *travels[:-1]).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times")).repartition("did")
        source = unique = docs.select("did", "text").dropDuplicates(["did"])
    keys, span = [("h1", pa.int64()), ("h2", pa.int64())], [("did", kind), ("at", pa.int32()), ("number", pa.int32())]
    ddl = ("did long" if packs else "did struct<id:bigint,text:bigint>") + ", at int, number int"

    def first(rows: DataFrame) -> DataFrame:
        """The place of the first row of those with equal digests."""
        if packs:
            place: Column = F.shiftleft("did", bits) + F.col("at")
            key = rows.groupBy("h1", "h2").agg(F.min(place).alias("place"))
            return key.select(F.shiftright("place", bits).alias("did"), F.col("place").bitwiseAND((1 << bits) - 1).cast("int").alias("at"))
        return rows.groupBy("h1", "h2").agg(F.min(F.struct("did", "at")).alias("p")).select("p.did", "p.at")

    def by_document(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("did").agg(F.collect_list(F.struct("at", "number")).alias(name))

    def symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                start, sym = symbols(block, block.hashes(), LOCAL_ROUNDS)
                first = np.searchsorted(start, block.first)
                at = start - np.repeat(block.first[:-1], np.diff(first))
                yield _symbol_rows(batch.column("did").slice(block.rows.start, len(block.start)), pa.array(block.n_words.astype(np.int32)), at, sym, first)

    def tile_rows(block: Block, batch: pa.RecordBatch) -> dict:
        start, number = _spans(block, batch, "shared")
        doc = block.wdoc[start]
        h1, h2 = _digests(block, start, start + number + width - 1)
        return {"h1": h1, "h2": h2, "did": _did(block, batch, doc), "at": (start - block.first[doc]).astype(np.int32), "number": number.astype(np.int32)}

    def fresh(block: Block, batch: pa.RecordBatch) -> np.ndarray:
        """Whether a window starts at each word that is in no tile, or in the first of equal ones."""
        live = np.arange(len(block.ws)) + width <= np.repeat(block.first[1:], block.n_words)
        start, number = _spans(block, batch, "shared")
        lead = np.isin(start, _spans(block, batch, "leads")[0])
        live[ranges(start[~lead], number[~lead])] = False
        return live

    def anchor_rows(block: Block, batch: pa.RecordBatch) -> dict:
        live = fresh(block, batch)
        name, place = anchors(block, block.hashes(), width)
        at = np.flatnonzero(live)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]]) | (name[at[1:]] != name[at[:-1]]) | (block.wdoc[at[1:]] != block.wdoc[at[:-1]])
        lead = np.flatnonzero(new)
        number = np.diff(np.append(lead, len(at)))
        at = at[lead]
        doc = block.wdoc[at]
        return {"sym": name[at].view(np.int64), "did": _did(block, batch, doc), "at": (at - block.first[doc]).astype(np.int32), "number": number.astype(np.int32)}

    def window_rows(block: Block, batch: pa.RecordBatch) -> dict:
        start = ranges(*_spans(block, batch, "wanted"))
        doc = block.wdoc[start]
        h1, h2 = _digests(block, start, start + width)
        return {"h1": h1, "h2": h2, "did": _did(block, batch, doc), "at": (start - block.first[doc]).astype(np.int32)}

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                n = len(block.ws)
                gone = ~fresh(block, batch) & (np.arange(n) + width <= np.repeat(block.first[1:], block.n_words))
                gone[ranges(*_spans(block, batch, "wanted"))] = True
                gone[ranges(*_spans(block, batch, "firsts"))] = False
                at = np.flatnonzero(gone)
                covered = cover(n, at, at + width)
                out, begin = block.joined(~covered)
                texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                removed = np.bincount(block.wdoc[covered], minlength=len(block.start))
                arrays = [batch.column("did").slice(block.rows.start, len(texts)), pa.array(block.n_words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                if carry is not None:
                    arrays.append(pa.array(texts, pa.binary()).cast(pa.string()))
                arrays += [batch.column(given.get(c, c)).slice(block.rows.start, len(texts)) for c in carried]
                yield pa.RecordBatch.from_arrays(arrays, names=["did", *names])

    table = save(source.mapInArrow(symbol_rows, ddl.split(", at")[0] + ", n int, at array<int>, sym array<bigint>"))
    for level in range(LOCAL_ROUNDS, LOCAL_ROUNDS + ROUNDS):
        before, table = table, save(another_round(table, level))
        drop(before)
    # a tile's windows end where the next symbol starts, or with the last one that the document has
    placed = table.withColumn("last", F.transform("at", lambda _, i: F.least(F.coalesce(F.get("at", i + 1), F.col("n")), F.col("n") - (width - 1))))
    placed = placed.select("did", F.inline(F.arrays_zip("at", "sym", "last"))).select("did", "at", "sym", (F.col("last") - F.col("at")).alias("number")).where("number > 0")
    known = placed.groupBy("sym").agg(F.count(F.lit(1)).alias("times"))  # the symbol table
    again = known.where("times > 1").select("sym").repartition(F.xxhash64("sym"))  # an exchange on either side of the join: it can split a hot symbol
    shared = save(by_document(placed.join(again, "sym"), "shared"))
    drop(table)
    tiles = unique.join(shared, "did").mapInArrow(_rows(tile_rows, pa.schema(keys + span)), f"h1 long, h2 long, {ddl}")
    leads = by_document(first(tiles).withColumn("number", F.lit(1)), "leads")
    told = lambda rows: rows.join(shared, "did", "left").join(leads, "did", "left")
    low_level = told(unique).mapInArrow(_rows(anchor_rows, pa.schema([("sym", pa.int64()), *span])), f"sym long, {ddl}")
    repeated = low_level.groupBy("sym").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sym")
    repeated = repeated.repartition(F.xxhash64("sym"))  # so that the join has an exchange on either side, and can split a hot symbol
    wanted = by_document(low_level.join(repeated, "sym"), "wanted")
    windows = unique.join(wanted, "did").mapInArrow(_rows(window_rows, pa.schema([*keys, *span[:2]])), 'h1 long, h2 long, ' + ddl.rpartition(',')[0])
    firsts = by_document(first(windows).withColumn("number", F.lit(1)), "firsts")
    joined = told(docs).join(wanted, "did", "left").join(firsts, "did", "left").select("did", "text", *travels, "shared", "leads", "wanted", "firsts")
    types = {"n_words": "long", "n_removed": "long", "kept_sha256": "string"} | ({"kept_text": "string"} if carry is not None else {}) | {c: dict(docs.dtypes)[given.get(c, c)] for c in carried}
    names = list(types)
    out = joined.mapInArrow(result, ", ".join([ddl.split(", at int")[0], *(f"`{c}` {t}" for c, t in types.items())]))
    if not packs:
        out = out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    ident = F.col("did") + F.lit(low or 0) if packs else F.when(F.col("did.id") > -(1 << 63), F.col("did.id"))
    return out.select(ident.alias(id_col), *(F.col(f"`{c}`") for c in names if c != "times"))
