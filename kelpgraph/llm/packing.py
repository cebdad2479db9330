"""Packing of documents into sequences of several permitted lengths.

Method. Variable-capacity best-fit. Documents longer than the largest length are cut into pieces of it. Pieces go, the
longest first, into the open bin with the least room that takes them. If none does, each permitted size is tried on the
pieces that are left: the longest that fits goes in, again and again; the size is opened whose cost, once shrunk to these
contents, is least for each of their tokens. So the lengths are chosen jointly with what can fill them. At the end each
bin shrinks to the shortest length for its contents.

Documents are dealt by a hash into groups of a bounded number of tokens, each packed by itself: a group is a few million
tokens, so what groups lose at their ends is a bin or so for thousands. Only ids and lengths are shuffled; copies of one
document are dealt in items of a bounded number of tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import n_words
from .tables import save


@dataclass(frozen=True)
class Lengths:
    """Permitted lengths and the cost of a sequence: fixed + length + length**2 / attention."""

    sizes: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    fixed: float = 64.0
    attention: float = 65_536.0
    group_tokens: int = 4_000_000

    def cost(self, size: int) -> float:
        return self.fixed + size + size * size / self.attention


PRODUCTION = Lengths()
#: Repeated rows of one document are packed so many to an item of the shuffle, or fewer: up to 1/ITEMS of a group's tokens.
COPIES, ITEMS = 256, 16


def filled(size: int, room: int, number: list[int], mask: int) -> int:
    """Tokens of a bin that starts with `size` of them: of the pieces left (number by length; mask: the lengths there are)
    the longest that fits is added until none does."""
    left = room - size
    while left and (fits := mask & ((1 << left + 1) - 1)):
        length = fits.bit_length() - 1
        left -= min(number[length], left // length) * length
        mask &= ~(1 << length)
    return room - left


def best_fit(pieces: list[int], lengths: Lengths) -> tuple[list[int], list[int], list[int]]:
    """For each piece (longest first) its bin and its place there, and for each bin its final length."""
    sizes = sorted(lengths.sizes)
    rooms: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    mask = 0  # bit r: some open bin has r tokens of room
    number, there = [0] * (sizes[-1] + 1), 0  # of the pieces left; bit n: some have length n
    for size in pieces:
        number[size] += 1
        there |= 1 << size
    bins, places, used = [], [], []
    for size in pieces:
        number[size] -= 1
        if not number[size]:
            there &= ~(1 << size)
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            tried = []
            for s in sizes:
                if s >= size:
                    held = filled(size, s, number, there)
                    tried.append((lengths.cost(next(x for x in sizes if x >= held)) / held, s))
            room = min(tried)[1]
            at = len(used)
            used.append(0)
        bins.append(at)
        places.append(used[at])
        used[at] += size
        if room > size:
            rooms[room - size].append(at)
            mask |= 1 << room - size
    return bins, places, [next(s for s in sizes if s >= u) for u in used]


def pack(documents: DataFrame, lengths: Lengths = PRODUCTION, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, copy (of repeated rows, from 0), piece, start and n_tokens (within the document), pack_group,
    bin (within the group), place (within the bin), bin_tokens, bin_length.

    Tokens are words. A document without words (null, empty) has one piece of 0 tokens and no bin (null). Repeated rows
    of one id and length are copies, each packed; ties of length go by id (null first), copy and piece.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), n_words(F.col(text_col)).alias("n"))
    rows = save(rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("times")))
    total = rows.agg(F.sum(F.col("n") * F.col("times"))).first()[0] or 0
    groups = max(1, -(-total // lengths.group_tokens))
    rows = rows.withColumn("item", F.greatest(F.lit(1), F.least(F.lit(COPIES), F.expr(f"{lengths.group_tokens // ITEMS} div greatest(n, 1)"))).cast("long"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.col("item"))))
    rows = rows.withColumn("count", F.least(F.col("item"), F.col("times") - F.col("chunk")))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "n", "chunk"), F.lit(groups)).cast("int"))
    largest = max(lengths.sizes)
    columns = ["doc_id", "copy", "piece", "start", "n_tokens", "pack_group", "bin", "place", "bin_tokens", "bin_length"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(doc_id=frame.doc_id.astype("Int64")).sort_values(["doc_id", "n", "chunk"], na_position="first")
        items = []
        for row, (n, chunk, count) in enumerate(zip(frame.n, frame.chunk, frame["count"], strict=True)):
            for copy in range(chunk, chunk + count):
                items += [(min(largest, n - s), row, copy, s // largest, s) for s in range(0, n, largest)]
        items.sort(key=lambda x: (-x[0], x[1:]))
        bins, places, final = best_fit([x[0] for x in items], lengths)
        out = pd.DataFrame(items, columns=["n_tokens", "row", "copy", "piece", "start"]).astype("int64")
        out["doc_id"] = frame.doc_id.iloc[out.row].array
        out["bin"], out["place"] = pd.array(bins, "Int64"), pd.array(places, "Int64")
        out["bin_tokens"] = out.groupby("bin").n_tokens.transform("sum").astype("Int64")
        out["bin_length"] = pd.array([final[b] for b in bins], "Int64")
        out["pack_group"] = int(frame.pack_group.iloc[0])
        return out[columns]

    packed = rows.where("n > 0").select("doc_id", "n", "chunk", "count", "pack_group").groupBy("pack_group").applyInPandas(run, "doc_id long, copy long, piece long, start long, n_tokens long, pack_group int, bin long, place long, bin_tokens long, bin_length long")
    none = rows.where("n = 0").withColumn("copy", F.explode(F.sequence(F.col("chunk"), F.col("chunk") + F.col("count") - 1)))
    empty = {"piece": F.lit(0).cast("long"), "start": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")} | {c: F.lit(None).cast("long") for c in ("bin", "place", "bin_tokens", "bin_length")}
    none = none.withColumns(empty).withColumn("pack_group", F.lit(None).cast("int"))
    out = packed.unionByName(none.select(*columns))
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
