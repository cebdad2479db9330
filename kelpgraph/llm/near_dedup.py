"""Near-duplicate documents by SuperMinHash, banding, verification on full shingle sets and union-find.

1. Each document's set of word shingles gets a SuperMinHash signature: an element's values for the slots are a random
   permutation of 0..m-1 plus a fraction, so an element with rank i in a slot has other ranks elsewhere (correlated,
   which lowers the variance). Ranks are dealt level by level; a document stops as soon as all its slots are filled.
2. Documents of one set are one class; only its smallest id goes on.
3. Bands of the signature are buckets; buckets with the same members count once. In a bucket of up to BLOCK classes, pairs
   whose signatures agree too little to reach the threshold are dropped, and each pair counts in one of the buckets that
   it shares. Only rows of pairs that are left send their texts to be confirmed on the full sets, those of most agreement
   first, unless links already confirmed connect them. What comes out are links that span a bucket's connections, never
   its pairs.
4. Members of larger buckets are first compared with one center: each class with that of the largest bucket that holds
   it (the member of most company over all buckets); then those outside of their bucket's largest connected part with the one
   of most company among them, as long as that finds links and STARS times at most. Members that links found so far connect need
   no comparison, so buckets that are connected are done, of whatever size. Of the others, what is outside of a large
   bucket's largest part is compared with all of it in pairs of blocks, as in 3.
5. Components of the links give the groups.

Bands, rows and the least agreement follow from the threshold (`scheme`): a pair at the threshold misses all bands with
a probability of at most 8e-7 (24 bands of 5 for 0.85, 27 of 4 for 0.8), and its signatures agree in too few slots with
at most 2e-7, were the slots independent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import drop, save
from .tokens import U, WORDS, Block, blocks, mix

#: Slots of a signature, unless one row a band needs more; and how often a pair at the threshold may miss all bands, or
#: agree in too few slots.
SLOTS = 120
MISSED, DISAGREED = 8e-7, 2e-7
BLOCK, STARS = 256, 3
#: Bits of the filter of ids whose texts are needed, at most (8 MB).
FILTER_BITS = 1 << 26


class Scheme(NamedTuple):
    bands: int
    rows: int
    agree: int  # slots in which a candidate pair's signatures agree at least

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def scheme(percent: int) -> Scheme:
    """The most selective bands and agreement that miss a pair at the threshold no more often than MISSED and DISAGREED."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    s = percent / 100
    needed = lambda rows: 1 if s == 1 else ceil(log(MISSED) / log(1 - s**rows))
    rows = 1
    while rows < SLOTS and needed(rows + 1) * (rows + 1) <= SLOTS:
        rows += 1
    bands, agree, tail = needed(rows), 0, 0.0
    slots = bands * rows
    while agree < slots and (tail := tail + comb(slots, agree) * s**agree * (1 - s) ** (slots - agree)) <= DISAGREED:
        agree += 1
    return Scheme(bands, rows, agree)


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle, by document. Fewer words than width: all of them are the one shingle."""
    words = block.hashes(fold=True)
    n = block.n_words
    number = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), number)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + block.first[doc]
    hashes = WORDS.between(WORDS.prefix(words), start, start + np.minimum(width, n)[doc])
    order = np.argsort((doc.astype(U) << U(44)) | (hashes >> U(20)), kind="stable")
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def superminhash(doc: np.ndarray, element: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures, docs x slots: in the upper half of each value the rank, in the lower the fraction."""
    out = np.full(docs * slots, ~U(0))
    permutation = None
    for rank in range(slots):
        draw = mix(element + U((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        other = rank + (((draw >> U(32)) * U(slots - rank)) >> U(32)).astype(np.int64)
        if permutation is None:
            slot = other
        else:
            row = np.arange(len(doc))
            slot = permutation[row, other].astype(np.int64)
            permutation[row, other] = permutation[:, rank]
            permutation[:, rank] = slot
        np.minimum.at(out, doc * slots + slot, (U(rank) << U(32)) | (draw & U(0xFFFFFFFF)))
        present = np.zeros(docs, bool)
        present[doc] = True
        going = present & (out.reshape(docs, slots).max(axis=1) >= U(rank + 1) << U(32))
        on = going[doc]
        if not on.any():
            break
        doc, element = doc[on], element[on]
        if permutation is None:
            other = other[on]
            permutation = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint32), (len(doc), 1))
            permutation[np.arange(len(doc)), other], permutation[:, 0] = 0, other
        else:
            permutation = permutation[on]
    return out.reshape(docs, slots)


def _signatures(width: int, plan: Scheme):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, limit=1 << 20):
                docs = len(block.start)
                doc, element = shingles(block, width)
                size = np.bincount(doc, minlength=docs).astype(np.int64)
                edge = np.concatenate(([0], np.cumsum(size)))
                sums = [np.concatenate((np.zeros(1, U), np.cumsum(mix(element * U(k))))) for k in (3, 5)]
                s1, s2 = (mix(x[edge[1:]] - x[edge[:-1]] + size.astype(U)).view(np.int64) for x in sums)
                signature = superminhash(doc, element, docs, plan.slots)
                key = np.zeros((docs, plan.bands), U)
                for row in range(plan.rows):
                    key = mix(key * U(0xC2B2AE3D27D4EB4F) + signature[:, row :: plan.rows] + np.arange(1, plan.bands + 1, dtype=U))
                bands = pa.ListArray.from_arrays(np.arange(docs + 1, dtype=np.int32) * plan.bands, pa.array(key.ravel().view(np.int64)))
                short = np.ascontiguousarray((signature & U(0xFFFF)).astype(np.uint16))
                ids = batch.column("did").slice(block.rows.start, docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(s1), pa.array(s2), bands, pa.array([x.tobytes() for x in short], pa.binary())], names=["did", "n", "s1", "s2", "bands", "signature"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal values of the columns, several together; rows come sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        last = np.ones(table.num_rows, bool)
        for c in columns:
            values = table.column(c).to_numpy()
            last &= values == values[-1]
        cut = table.num_rows - int(last[::-1].argmin() if not last.all() else table.num_rows)
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


#: What a group of rows is: a whole bucket, a block of one with the center of a star (side 1), or two blocks of one.
WHOLE, STAR, BLOCKS = 0, 1, 2


def _candidates(table: pa.Table, percent: int, plan: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows that can be linked, for each group of key, i and j, and in how many slots they agree. In buckets and
    blocks a pair counts in one bucket alone: that of the least key that it shares (of buckets with the same members the
    least was kept, too)."""
    column = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "kind", "n", "side", "label")}
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, plan.slots)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, plan.bands)
    new = np.ones(table.num_rows, bool)
    new[1:] = np.any([column[c][1:] != column[c][:-1] for c in ("key", "i", "j")], axis=0)
    start = np.append(np.flatnonzero(new), table.num_rows)
    size = np.diff(start)
    two = start[:-1][size == 2]  # most buckets: dropped or not all at once
    two = two[(sig[two] == sig[two + 1]).sum(axis=1) >= plan.agree]
    for a, b in sorted([(a, a + 2) for a in two.tolist()] + [(a, b) for a, b, k in zip(start[:-1].tolist(), start[1:].tolist(), size.tolist(), strict=True) if k > 2]):
        n, kind = column["n"], column["kind"][a]
        # the rows of one side against those of the other, or all against all
        one = np.arange(a, b) if kind == WHOLE else a + np.flatnonzero(column["side"][a:b] == 1)
        other = one if kind == WHOLE else a + np.flatnonzero(column["side"][a:b] == 0)
        agree = np.zeros((len(one), len(other)), np.int16)
        for slot in range(plan.slots):
            agree += sig[one, slot][:, None] == sig[other, slot][None, :]
        fits = agree >= plan.agree
        fits &= column["label"][one][:, None] != column["label"][other][None, :]
        if kind == WHOLE:
            fits = np.triu(fits, 1)
        x, y = np.nonzero(fits)
        found, x, y = agree[x, y], one[x], other[y]
        good = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        if kind != STAR:
            shared = np.where(bands[x] == bands[y], bands[x], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            good &= shared == column["key"][a]
        if good.any():
            yield x[good], y[good], found[good]


def _taking_part(percent: int, plan: Scheme):  # noqa: ANN202
    """The rows that are in any pair that can be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "i", "j"]):
            some = [np.union1d(x, y) for x, y, _ in _candidates(table, percent, plan)]
            rows = table.select(["key", "i", "j", "kind", "rep", "s1", "side", "label"]).take(pa.array(np.concatenate([*some, np.zeros(0, np.int64)]).astype(np.int64)))
            yield from rows.combine_chunks().to_batches()

    return run


def _links(width: int, percent: int, plan: Scheme):  # noqa: ANN202
    """Links (u, v) that are confirmed on the full sets and span what they connect within each group of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "i", "j"]):
            rep, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
            u, v = [], []
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := up.get(x, x)) != x:  # noqa: B023
                    up[x] = up.get(y, y)  # noqa: B023
                    x = y
                return x

            for x, y, agree in _candidates(table, percent, plan):
                need = np.unique(np.concatenate((x, y)))
                rows = table.select(["text"]).take(pa.array(need)).combine_chunks().to_batches()[0]
                block = next(blocks(rows, limit=1 << 62))
                doc, element = shingles(block, width)
                edge = np.searchsorted(doc, np.arange(len(need) + 1))
                order = np.argsort(-agree, kind="stable")
                for c, d in zip(x[order].tolist(), y[order].tolist(), strict=True):
                    if root(label[c]) == root(label[d]):
                        continue
                    k, m = np.searchsorted(need, (c, d))
                    p, q = element[edge[k] : edge[k + 1]], element[edge[m] : edge[m + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        up[root(label[c])] = root(label[d])
                        u.append(rep[c])
                        v.append(rep[d])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


_ROW = ["key", "i", "j", "kind", "rep", "s1", "side", "label"]
_DDL = "key long, i int, j int, kind int, rep long, s1 long, side int, label long"


def _dealt(rows: DataFrame) -> DataFrame:
    """Groups of rows in one task each, in order."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep", "s1")


def _stars(members: DataFrame, confirmed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """members (key, size, rep, s1) with label, the part that links connect them in, and those links: of classes of buckets
    of over BLOCK with one center each, again and again."""
    links: list[DataFrame] = []
    number = lambda x: F.lit(x).cast("int")
    part = F.pmod(F.xxhash64("rep", "s1"), F.ceil(F.col("size") / BLOCK).cast("int")).cast("int").alias("i")
    company = members.groupBy("rep", "s1").agg(F.sum("size").alias("company"), F.max("size").alias("most")).where(F.col("most") > BLOCK).drop("most")
    large = save(members.where(F.col("size") > BLOCK).join(company, ["rep", "s1"]).withColumn("label", F.col("rep")))
    known = None
    for turn in range(STARS):
        ranked = large
        if turn:  # what is outside of the largest part of each bucket
            most = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(F.max_by("label", F.struct("rows", "label")).alias("largest"))
            ranked = large.join(most, "key").where("label != largest").drop("largest")
        centers = ranked.groupBy("key").agg(F.max(F.struct("company", F.col("rep").alias("c_rep"), F.col("s1").alias("c_s1"), F.col("label").alias("c_label"))).alias("c")).select("key", "c.c_rep", "c.c_s1", "c.c_label")
        one = F.max_by(F.struct("key", "size", "c_label", "c_rep", "c_s1"), F.struct("size", "key"))
        sent = save(ranked.join(centers, "key").where("label != c_label").groupBy("rep", "s1", "label").agg(one.alias("b")).select("rep", "s1", "label", "b.*"))
        if sent.isEmpty():
            drop(sent)
            break
        mine = sent.select("key", part, number(-1).alias("j"), number(STAR).alias("kind"), "rep", "s1", number(0).alias("side"), "label")
        own = sent.select("key", part, "c_rep", "c_s1", "c_label").distinct()
        own = own.select("key", "i", number(-1).alias("j"), number(STAR).alias("kind"), F.col("c_rep").alias("rep"), F.col("c_s1").alias("s1"), number(1).alias("side"), F.col("c_label").alias("label"))
        new = confirmed(mine.unionByName(own))
        drop(sent)
        if new.isEmpty():
            break
        links.append(new)
        known = components(_union(links)).withColumnRenamed("node", "rep")
        before, large = large, save(large.drop("label").join(known, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"))
        drop(before)
    drop(large)
    if known is None:
        return members.withColumn("label", F.col("rep")), links
    return members.join(known, "rep", "left").select("key", "size", "rep", "s1", F.coalesce("component", "rep").alias("label")), links


def _blocks_of(labelled: DataFrame, signatures: DataFrame) -> DataFrame:
    """Rows (of _ROW and the signatures) of large buckets that labels don't connect: those outside of the largest part
    against all. Signatures are joined before a row goes to its blocks."""
    number = lambda x: F.lit(x).cast("int")
    parts, at = F.ceil(F.col("size") / BLOCK).cast("int"), lambda n: F.pmod(F.xxhash64("rep", "s1"), n).cast("int")
    largest = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(F.max_by("label", F.struct("rows", "label")).alias("largest"), (F.sum("rows") - F.max("rows")).alias("rest"))
    told = labelled.join(largest.where("rest > 0"), "key").join(signatures, ["rep", "s1"])
    blocks_ = F.ceil(F.col("rest") / BLOCK).cast("int")
    outside = F.when(F.col("label") != F.col("largest"), F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(at(blocks_).alias("i"), j.alias("j"), number(1).alias("side"))))
    all_ = F.transform(F.sequence(F.lit(0), blocks_ - 1), lambda i: F.struct(i.alias("i"), at(parts).alias("j"), number(0).alias("side")))
    told = told.withColumn("x", F.explode(F.concat(F.coalesce(outside, F.array().cast("array<struct<i:int,j:int,side:int>>")), all_)))
    return told.select("key", "x.i", "x.j", number(BLOCKS).alias("kind"), "rep", "s1", "x.side", "label", "n", "bands", "signature")


def flagged(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with `maybe`: true for all whose key is among the ids (of one column of that name), and for few others.

    A bit for each hash that occurs, 16 for an id and FILTER_BITS at most, goes to the tasks, so that texts that nothing
    needs are not shuffled; what is flagged is joined with the ids then."""
    size = min(FILTER_BITS, 1 << max(10, (16 * ids.count() - 1).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(size))
    words = ids.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), {size}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    mask = np.zeros(size // 64, np.int64)
    for r in words.collect():  # at most FILTER_BITS / 64 rows
        mask[r.word] = r.bits
    shared, names = rows.sparkSession.sparkContext.broadcast(mask), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(len(names)).to_numpy()
            hit = ((shared.value[place >> 6] >> (place & 63)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(hit)], names=[*names, "maybe"])

    return rows.withColumn("at_", at).mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "maybe boolean"]))


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose key isn't among the ids (a stored table of one column). Only rows that may be are shuffled."""
    told = flagged(rows, key, ids)
    return told.where("not maybe").drop("maybe").unionByName(told.where("maybe").drop("maybe").join(ids, key, "left_anti"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def groups(documents: DataFrame, *, width: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_shingles, component_id and kept: the smallest id reachable by links, and whether it is the row's own.

    Two documents are linked if 100 * shared shingles >= percent * all their shingles; A-Z count as a-z. A null or
    wordless text has no shingles and no links, even to another such. Rows of one id have the group of the smallest of
    their classes. A null id counts as the smallest, and its component_id is null where a null id is in the group.
    """
    plan = scheme(percent)
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"), F.col(text_col).cast("string").alias("text"))
    schema = "did long, n long, s1 long, s2 long, bands array<bigint>, signature binary"
    signed = save(docs.mapInArrow(_signatures(width, plan), schema))
    # equal sets have equal signatures, whichever row's is taken
    unique = save(signed.where("n > 0").groupBy("s1", "s2").agg(F.min("did").alias("rep"), *(F.first(c).alias(c) for c in ("n", "bands", "signature"))))
    classes = unique.select("s1", "s2", "rep")
    banded = unique.select("s1", "rep", F.explode("bands").alias("key"))
    member = F.xxhash64("rep", "s1")
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.shiftright(member, 20)).alias("f"), F.bit_xor(member).alias("g")).where("size > 1")
    buckets = buckets.groupBy("size", "f", "g").agg(F.min("key").alias("key"))  # buckets with the same members: once
    members = save(banded.join(buckets.select("key", "size"), "key").select("key", "size", "rep", "s1"))

    # always by a shuffle of both: how many ids there are grows with the input
    ends = save(members.select("rep", "s1").distinct())
    ids = ends.select(F.col("rep").alias("did")).distinct().hint("merge")
    texts = flagged(docs, "did", ids).where("maybe").drop("maybe").join(ids, "did").select(F.col("did").alias("rep"), F.xxhash64("text").alias("h"), "text").dropDuplicates(["rep", "h"]).drop("h")
    signatures = save(unique.select("rep", "s1", "n", "bands", "signature").join(ends.hint("merge"), ["rep", "s1"], "left_semi"))
    sides = save(signatures.join(texts, "rep"))

    def confirmed(rows: DataFrame) -> DataFrame:
        """Links among groups of rows: by signatures alone first, then by the texts of the rows that are in candidate pairs."""
        if "signature" not in rows.columns:
            rows = rows.join(signatures, ["rep", "s1"])
        told = _dealt(rows.select(*_ROW, "n", "bands", "signature"))
        some = save(told.mapInArrow(_taking_part(percent, plan), _DDL).distinct())
        found = _dealt(some.join(sides, ["rep", "s1"]).select(*_ROW, "n", "bands", "signature", "text"))
        out = save(found.mapInArrow(_links(width, percent, plan), "u long, v long"))
        drop(some)
        return out

    labelled, links = members.withColumn("label", F.col("rep")), []
    if not members.where(F.col("size") > BLOCK).isEmpty():
        labelled, links = _stars(members, confirmed)
        labelled = save(labelled)
        apart = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
        labelled = save(labelled.join(apart, "key"))
        links.append(confirmed(_blocks_of(labelled.where(F.col("size") > BLOCK), signatures)))
    zero = F.lit(0)
    links.append(confirmed(labelled.where(F.col("size") <= BLOCK).select("key", zero.alias("i"), zero.alias("j"), F.lit(WHOLE).alias("kind"), "rep", "s1", zero.alias("side"), "label")))
    labels = components(_union(links))
    named = save(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("comp")))
    rows = save(signed.select("did", "n", "s1", "s2"))
    drop(signed, unique, members, ends, signatures, sides, labels, *links)
    out = rows.join(named, ["s1", "s2"], "left")
    comp = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("did"))
    ident = lambda c: F.when(c > -(1 << 63), c)
    return out.select(ident(F.col("did")).alias(id_col), F.col("n").alias("n_shingles"), ident(comp).alias("component_id"), (F.col("did") == comp).alias("kept"))
