"""MinHash signatures, bands and text similarity.

The hash family is fixed: p = 2**31 - 1 and pairs (a, b) drawn alternately from NumPy's legacy generator of seed 42; a
token's hash is the little-endian number of the first four bytes of its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save

PERMUTATIONS, BANDS, PRIME = 128, 16, 2**31 - 1
#: Tokens of documents that are permuted together; classes of a bucket that are compared at once.
BLOCK_TOKENS, BLOCK = 1 << 16, 256
#: Where bands don't select: the most classes in a block; pairs of them whose bits are compared, and that are ranked, at once.
ROWS, TILE, RANKED = 5000, 1 << 16, 1 << 20


@cache
def family(seed: int = 42, n: int = PERMUTATIONS) -> tuple[tuple[int, ...], tuple[int, ...]]:
    rng = np.random.RandomState(seed)  # noqa: NPY002
    pairs = [(int(rng.randint(1, PRIME)), int(rng.randint(0, PRIME))) for _ in range(n)]
    return tuple(a for a, _ in pairs), tuple(b for _, b in pairs)


def token_hash(token: Column) -> Column:
    """The same as a Column."""
    h = F.sha2(token.cast("binary"), 256)
    return F.conv(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([A-Za-z0-9_]+)"), 1))


def space_set(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(F.trim(text)), r"[ \t\r\n]+")), lambda t: t != "")


def minhash(tokens: list[str]) -> np.ndarray:
    """The signature of a token set; zeros if it is empty."""
    if not tokens:
        return np.zeros(PERMUTATIONS, np.int64)
    return _permuted(_hashes(tokens)).min(axis=0).astype(np.int64)


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little") for t in tokens], np.uint64)


def _permuted(h: np.ndarray) -> np.ndarray:
    """tokens x permutations."""
    a, b = (np.array(x, np.uint64)[None, :] for x in family())
    return np.concatenate([((h[k : k + 4096, None] * a + b) % np.uint64(PRIME)).astype(np.uint32) for k in range(0, len(h), 4096)])


def bands(signature: np.ndarray) -> list[str]:
    """16 band keys: the first eight bytes of the SHA-256 of eight little-endian 32-bit values, as hex."""
    rows = signature.astype("<u4").reshape(BANDS, -1)
    return [hashlib.sha256(r.tobytes()).digest()[:8][::-1].hex() for r in rows]


def signatures(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, signature array<bigint>, bands array<string>, by Arrow batches (map-side).

    A block of documents hashes and permutes each of its distinct tokens once. Where the rows lie in fewer partitions
    than there are cores, they are dealt out first."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(size)))
            flat, low = column.flatten(), 0
            while low < len(size):
                high = max(low + 1, int(np.searchsorted(first, first[low] + BLOCK_TOKENS, "right")) - 1)
                coded = flat.slice(int(first[low]), int(first[high] - first[low])).dictionary_encode()
                out = np.zeros((high - low, PERMUTATIONS), np.uint32)
                full = np.flatnonzero(size[low:high])
                if len(full):
                    permuted = _permuted(_hashes(coded.dictionary.to_pylist()))
                    out[full] = np.minimum.reduceat(permuted[coded.indices.to_numpy()], (first[low:high] - first[low])[full])
                keys = [bands(x) for x in out]
                flat_out = pa.ListArray.from_arrays(np.arange(high - low + 1, dtype=np.int32) * PERMUTATIONS, pa.array(out.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), flat_out, pa.array(keys, pa.list_(pa.string()))], names=[key, "signature", "bands"])
                low = high

    rows = rows.select(key, tokens)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows.mapInArrow(run, f"{key} {kind}, signature array<bigint>, bands array<string>")


def agreement(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.when(x == y, F.lit(1))), lambda m: m.isNotNull())) / F.lit(float(PERMUTATIONS))


def drift(before: Column, after: Column) -> Column:
    """The share of bands that differ, place by place."""
    return F.aggregate(F.zip_with(before, after, lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, v: s + v) / F.lit(float(BANDS))


def to_text(signature: Column) -> Column:
    """Eight hex digits for each slot."""
    return F.lower(F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def from_text(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1)), lambda k: F.conv(F.substring(text, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def index(signed: DataFrame, key: str) -> DataFrame:
    """key, band, value, signature: a row for each band, as a table that others are put into and taken from."""
    return signed.select(key, F.posexplode("bands").alias("band", "value"), "signature")


def insert(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """held with the keys of new, whose rows take the place of those of equal key."""
    return held.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(held: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return held.join(keys.select(key).distinct(), key, "left_anti")


def probe(held: DataFrame, asked: DataFrame, asked_key: str, key: str, least: float) -> DataFrame:
    """asked_key, key, similarity: keys of the index that share a band with a query and agree in `least` of the slots."""
    hits = index(asked, asked_key).drop("signature").join(held.select(key, "band", "value"), ["band", "value"]).where(F.col(asked_key) != F.col(key)).select(asked_key, key).distinct()
    found = hits.join(asked.select(asked_key, F.col("signature").alias("s")), asked_key).join(held.where("band = 0").select(key, "signature"), key)
    return found.select(asked_key, key, agreement(F.col("s"), F.col("signature")).alias("similarity")).where(F.col("similarity") >= least)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def _first(x: np.ndarray, score: np.ndarray, name: np.ndarray, top: int) -> np.ndarray:
    """Where the `top` best of each x are: the highest scores, then the smallest names."""
    order = np.lexsort((name, -score, x))
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])
    place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return order[place < top]


def _pairs(slots: int, equal: int, top: int):  # noqa: ANN202
    """(a, b, agree): of each row of two blocks of a bucket its `top` best in the other one, from `equal` slots on.

    A pair counts in the first band alone that it has in common."""

    def found(key: np.ndarray, name: np.ndarray, band: int, sig: np.ndarray, one: np.ndarray, other: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        agree = np.zeros((len(one), len(other)), np.int16)
        first = np.full((len(one), len(other)), -1, np.int16)
        for k in range(sig.shape[1] // slots):
            shared = np.ones(first.shape, bool)
            for slot in range(k * slots, k * slots + slots):
                same = sig[one, slot][:, None] == sig[other, slot][None, :]
                agree += same
                shared &= same
            first[shared & (first < 0)] = k
        for slot in range(sig.shape[1] // slots * slots, sig.shape[1]):
            agree += sig[one, slot][:, None] == sig[other, slot][None, :]
        agree[(agree < equal) | (first != band)] = 0
        if whole:
            np.fill_diagonal(agree, 0)
        for scores, mine, others in ((agree, one, other),) if whole else ((agree, one, other), (agree.T, other, one)):
            x, y = np.nonzero(scores)
            if len(x):
                kept = _first(x, scores[x, y], name[others[y]], top)
                x, y = x[kept], y[kept]
                yield pa.RecordBatch.from_arrays([pa.array(key[mine[x]]), pa.array(key[others[y]]), pa.array(scores[x, y].astype(np.int32))], names=["a", "b", "agree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _ended(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            place = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
            start = np.flatnonzero(np.append(True, np.any([p[1:] != p[:-1] for p in place], axis=0)))
            ends = np.append(start[1:], table.num_rows)
            if batch is not None:  # the last group may go on
                rest, ends, start = table.slice(int(start[-1])), ends[:-1], start[:-1]
            if not len(start):
                continue
            key, band, side = (table.column(c).to_numpy() for c in ("rep", "band", "side"))
            name = np.unique(table.column("name").to_numpy(), return_inverse=True)[1]  # places in their order
            sig = np.frombuffer(b"".join(table.column("packed").slice(0, int(ends[-1])).to_pylist()), ">u4").astype(np.uint32).reshape(int(ends[-1]), -1)
            for a, b in zip(start.tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    whole = place[1][a] == place[2][a]
                    one = np.arange(a, b) if whole else a + np.flatnonzero(side[a:b] == place[1][a])
                    other = one if whole else a + np.flatnonzero(side[a:b] != place[1][a])
                    yield from found(key, name, band[a], sig, one, other, whole)

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _bits(sig: np.ndarray) -> np.ndarray:
    """Two bits of each slot, mixed from its value, as planes x words x rows."""
    mixed = sig * np.uint32(0x9E3779B1)
    planes = [np.packbits((mixed >> np.uint32(k)).astype(np.uint8) & 1, axis=1).view(np.uint64).T for k in (31, 30)]
    return np.ascontiguousarray(planes)


def _alike(one: np.ndarray, other: np.ndarray, equal: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, agree): all rows of two blocks of signatures that agree in `equal` slots or more.

    Slots whose bits differ have other values, so a pair with more than 128 - `equal` of these is out; whole values decide
    on the rest."""
    p, q = _bits(one), _bits(other)
    step = max(1, TILE // len(other))
    for low in range(0, len(one), step):
        differ = 0
        for word in range(p.shape[1]):
            apart = p[0, word, low : low + step, None] ^ q[0, word]
            apart |= p[1, word, low : low + step, None] ^ q[1, word]
            differ = differ + np.bitwise_count(apart)
        x, y = np.divmod(np.flatnonzero(differ <= PERMUTATIONS - equal), len(other))
        if len(x):
            x += low
            agree = np.count_nonzero(one[x] == other[y], axis=1).astype(np.int16)
            kept = agree >= equal
            yield x[kept], y[kept], agree[kept]


def _all_pairs(equal: int, top: int):  # noqa: ANN202
    """(a, b, agree, b_name): of each row of two blocks its `top` best in the other one, from `equal` slots on."""

    def told(x: np.ndarray, y: np.ndarray, agree: np.ndarray, mine: pa.Array, others: pa.Array, names: pa.Array) -> Iterator[pa.RecordBatch]:
        order = np.unique(names.to_numpy(zero_copy_only=False), return_inverse=True)[1]  # places in their order
        step = max(1, len(mine) * RANKED // len(x))
        for low in range(0, len(mine), step):
            part = np.flatnonzero((x >= low) & (x < low + step))
            if len(part):
                part = part[_first(x[part], agree[part], order[y[part]], top)]
                b = pa.array(y[part])
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(x[part])), others.take(b), pa.array(agree[part].astype(np.int32)), names.take(b)], names=["a", "b", "agree", "b_name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = (batch.column(c)[k].as_py() for c in ("i", "j"))
                one, other = (np.frombuffer(batch.column(c)[k].as_buffer(), ">u4").astype(np.uint32).reshape(-1, PERMUTATIONS) for c in ("packed_i", "packed_j"))
                found = list(_alike(one, other, equal))
                if not found:
                    continue
                x, y, agree = (np.concatenate(c) for c in zip(*found, strict=True))
                if i == j:
                    x, y, agree = (c[x != y] for c in (x, y, agree))
                if not len(x):
                    continue
                reps, names = ([batch.column(f"{c}_{side}")[k].values for side in "ij"] for c in ("reps", "names"))
                yield from told(x, y, agree, reps[0], reps[1], names[1])
                if i != j:
                    yield from told(y, x, agree, reps[1], reps[0], names[0])

    return run


def _blocks(most: int):  # noqa: ANN202
    """block, reps, names, packed: up to `most` classes in a row, under the first one's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in np.array_split(np.arange(batch.num_rows), -(-batch.num_rows // most) or 1):
                if len(part):
                    reps, names, packed = (batch.column(c).slice(int(part[0]), len(part)) for c in ("rep", "name", "packed"))
                    ends = pa.array([0, len(part)], pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, c) for c in (reps, names)]
                    yield pa.RecordBatch.from_arrays([reps.slice(0, 1), *lists, pa.array([b"".join(packed.to_pylist())])], names=["block", "reps", "names", "packed"])

    return run


def _compared(classes: DataFrame, kind: str, equal: int, top: int) -> DataFrame:
    """a, b, agree, b_name: the `top` best others of each class, by comparing all.

    Each task reads two parts of the table of blocks, from the folder where it is written: nothing is shuffled for a
    pair but what was found. Of (i, j) and (j, i) one is taken, by the parity of both, so that tasks have about as much to do."""
    blocks = save(classes.select("rep", "name", "packed").mapInArrow(_blocks(ROWS), f"block long, reps array<long>, names array<{kind}>, packed binary"))
    one, other = (blocks.toDF(side, f"reps_{side}", f"names_{side}", f"packed_{side}") for side in "ij")
    met = one.hint("shuffle_replicate_nl").join(other, F.expr("i = j or (i < j) = ((i ^ j) & 1 = 0)"))
    return met.mapInArrow(_all_pairs(equal, top), f"a long, b long, agree int, b_name {kind}")


def _banded(classes: DataFrame, slots: int, equal: int, top: int) -> DataFrame:
    """a, b, agree: the best others of each class in blocks of the buckets that they share."""
    value = lambda k: F.xxhash64(F.lit(k), F.substring("packed", 4 * slots * k + 1, 4 * slots))
    banded = classes.select("rep", F.posexplode(F.array(*(value(k) for k in range(PERMUTATIONS // slots)))).alias("band", "bucket"))
    buckets = banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    members = banded.join(buckets.drop("band"), "bucket").withColumn("side", F.pmod(F.col("rep"), parts).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select("bucket", "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep")
    met = members.join(classes.select("rep", "name", "packed"), "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    return met.mapInArrow(_pairs(slots, equal, top), "a long, b long, agree int")


def band_join(signed: DataFrame, key: str, least: float = 0.7, top: int = 10) -> DataFrame:
    """a, b, similarity, rank: the `top` most similar others of each row (ties: smaller key), of agreement `least` or more.

    Exact on signatures: of 128 slots at most m = 128 - ceil(128 * least) differ, so with m + 1 bands or more of equal
    width one agrees whole. Rows of equal signature are one class, of which the first top + 1 keys are enough. Classes
    that share a band's value meet in pairs of blocks, and what leaves a task is each class's best. The signature goes
    out only for buckets of more than one class, once for those of the same members.

    From `least` 0.5 down a band is one slot, whose values most classes share, so each would go out more than a hundred
    times. There all classes are compared instead, in blocks and by bits first: time grows with the square of the classes,
    disk with the classes and what is found.
    """
    kind = dict(signed.dtypes)[key]
    equal = max(1, -int(-least * PERMUTATIONS // 1))
    slots = max(1, PERMUTATIONS // (PERMUTATIONS - equal + 1))
    packed = F.unhex(to_text(F.col("signature")))
    rows = save(signed.select(F.col(key).alias("key"), packed.alias("packed")).select("*", F.xxhash64("packed").alias("rep"), F.crc32("packed").alias("mark")))
    salt = F.pmod(F.xxhash64("key"), F.lit(64))
    first = rows.drop("packed").withColumn("place", F.row_number().over(Window.partitionBy("rep", "mark", salt).orderBy("key"))).where(F.col("place") <= top + 1)
    first = first.groupBy("rep", "mark").agg(F.slice(F.array_sort(F.collect_list("key")), 1, top + 1).alias("keys"))
    first = first.join(rows.groupBy("rep", "mark").agg(F.any_value("packed").alias("packed")), ["rep", "mark"])
    classes = save(first.select("packed", "keys", F.element_at("keys", 1).alias("name"), "rep", "mark"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b_name"))
    members = classes.select(F.col("rep").alias("b"), F.col("name").alias("b_name"), F.col("keys").alias("b_keys"))
    if slots > 1:
        near = _banded(classes, slots, equal, top).join(members, "b").withColumn("place", best).where(F.col("place") <= top)
    else:  # the best in each task are found before they are shuffled
        near = _compared(classes, kind, equal, top).withColumn("place", best).where(F.col("place") <= top).drop("b_name").join(members, "b")
    near = near.select(F.col("a").alias("rep"), F.explode("b_keys").alias("b"), "agree")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("agree"), "b"))).where(F.col("place") <= top)
    others = near.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("place", "b", "agree"))).alias("others"))
    own = F.transform("keys", lambda k: F.struct(F.lit(0).alias("place"), k.alias("b"), F.lit(PERMUTATIONS).alias("agree")))
    none = F.array().cast(f"array<struct<place:int,b:{kind},agree:int>>")
    told = classes.drop("packed").join(others, "rep", "left").select("rep", "mark", F.concat(own, F.coalesce("others", none)).alias("all"))
    joined = rows.drop("packed").join(told, ["rep", "mark"]).select(F.col("key").alias("a"), F.slice(F.filter("all", lambda x: x["b"] != F.col("key")), 1, top).alias("all"))
    out = joined.select("a", F.posexplode("all").alias("pos", "x"))
    return out.select("a", F.col("x.b").alias("b"), (F.col("x.agree") / F.lit(float(PERMUTATIONS))).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def _shortened(names: DataFrame, most: int) -> DataFrame:
    """name, key: the name and what is left of it after up to so many deletions."""
    n = names.select(F.col(names.columns[0]).alias("name")).where("name is not null").distinct()
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    keys = level = F.array("name")
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, cut)))
        keys = F.concat(keys, level)
    return n.select("name", F.explode(F.array_distinct(keys)).alias("key"))


def near_pairs(left: DataFrame, right: DataFrame, most: int = 1) -> DataFrame:
    """a, b, distance: names of the left and of the right within `most` edits. Such two share themselves or a string with
    as many characters deleted, so an equi-join on those finds all. A name has many keys, which sizes that are estimated
    from its table don't show: the join is told to shuffle."""
    a, b = _shortened(left, most).withColumnRenamed("name", "a"), _shortened(right, most).withColumnRenamed("name", "b")
    pairs = a.hint("merge").join(b, "key").select("a", "b", F.levenshtein("a", "b", most).alias("distance"))
    return pairs.where("distance >= 0").distinct()


def close_names(names: DataFrame, most: int = 1) -> DataFrame:
    """a, b, distance: distinct names within `most` edits of each other, a before b."""
    return near_pairs(names, names, most).where("a < b")
