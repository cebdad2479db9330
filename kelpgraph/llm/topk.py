"""Exact top-k by inner product with block-at-a-time pruning.

Method. Vectors of whole numbers are cut, by ranges of ids, into blocks with the greatest and least value of each term.
For a query the sum over terms of weight times the better of the two bounds every score in a block. Blocks are visited
by falling bound and scored through their forward index (the vectors of the block), until a bound falls below the kth
score; a bound that equals it is still visited, since a tie may have a smaller id.

Blocks are held in chunks, which have bounds of their own, and chunks are pruned before a vector travels:

1. The chunks' bounds, some KB each, go to the query parts in pages. A query goes to the chunk that bounds it highest,
   whose kth score is a first threshold.
2. With it, a query goes on to the chunks alone whose bound reaches its threshold, and is scored there from that
   threshold on. The best k of all chunks are the result.

Every task holds a part of queries, a page of bounds or a chunk; nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import save

CHUNK, QUERIES, BLOCK = 16_384, 1_024, 256
#: Chunks whose bounds make a page.
PAGE = 256
_LOW = np.iinfo(np.int64).min


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes for each of the whole numbers, as few as hold them all (8: doubles as they are), and the numbers."""
    most = float(np.abs(values).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, values.astype("f8" if width == 8 else f"i{width}").tobytes()


def _wide(width: int, data: bytes, rows: int, dims: int) -> np.ndarray:
    """The numbers again, as doubles, with zeros up to dims."""
    values = np.frombuffer(data, "f8" if width == 8 else f"i{width}").astype(np.float64)
    values = values.reshape(rows, -1) if len(values) else np.zeros((rows, 0))
    return np.pad(values, ((0, 0), (0, dims - values.shape[1])))


def _chunks(size: int):  # noqa: ANN202
    """Rows of up to `size` vectors each: ids and values, in order of id, and the greatest and least of each term."""

    def make(ids: list[np.ndarray], vectors: list[np.ndarray], number: int, task: int) -> pa.RecordBatch:
        dims = max(v.shape[1] for v in vectors)
        values = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for v in vectors])
        width, data = _narrow(values)
        bounds = [pa.array([values.max(axis=0).tobytes()], pa.binary()), pa.array([values.min(axis=0).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(
            [pa.array([task * (1 << 24) + number], pa.int64()), pa.array([dims], pa.int32()), pa.array([width], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([data], pa.binary()), *bounds],
            names=["chunk", "dims", "width", "ids", "vectors", "top", "least"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, ids, vectors = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            lists = batch.column("vector")
            length = lists.value_lengths().to_numpy()
            flat = np.floor(lists.flatten().to_numpy() * 256)
            start = np.cumsum(length) - length
            for own in np.split(np.arange(len(length)), np.flatnonzero(np.diff(length)) + 1):
                while len(own):
                    take = own[: size - held]
                    own = own[len(take) :]
                    dims = int(length[take[0]])
                    ids.append(batch.column("vec_id").to_numpy()[take])
                    vectors.append(flat[start[take[0]] : start[take[0]] + dims * len(take)].reshape(len(take), dims))
                    held += len(take)
                    if held == size:
                        yield make(ids, vectors, number, task)
                        number, held, ids, vectors = number + 1, 0, [], []
        if held:
            yield make(ids, vectors, number, task)

    return run


def bounds(q: np.ndarray, top: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query and block, no less than any score in it: doubles round, so a little is added."""
    found = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ least.T
    return found + 1 + np.abs(found) * 1e-9


def search(name: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray | None = None, qid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of the query, vec_id, score) rows: the k best of the chunk for each query, of those that reach its floor and
    aren't its own id's; vid is in order.

    Scores are exact: in doubles where they fit 53 bits, else in 64-bit whole numbers."""
    qid = name if qid is None else qid
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if reach >= 2**63:
        raise OverflowError("scores beyond 64 bits")
    edges = np.arange(0, len(vid), BLOCK)
    bound = bounds(q, np.maximum.reduceat(v, edges), np.minimum.reduceat(v, edges))
    if reach >= 2**53:
        q, v = q.astype(np.int64), v.astype(np.int64)
    order = np.argsort(-bound, axis=1, kind="stable")
    best, who = np.full((len(qid), k), _LOW), np.full((len(qid), k), np.iinfo(np.int64).max)
    low = np.full(len(qid), _LOW) if floor is None else floor
    active = np.arange(len(qid))
    for turn in range(len(edges)):
        block = order[active, turn]
        least = np.maximum(best[active, -1], low[active])
        going = bound[active, block] >= least
        active, block = active[going], block[going]
        if not len(active):
            break
        for b in np.unique(block):
            mine, at = active[block == b], np.arange(edges[b], min(edges[b] + BLOCK, len(vid)))
            score = (q[mine] @ v[at].T).astype(np.int64)
            score[(vid[at][None, :] == qid[mine][:, None]) | (score < low[mine][:, None])] = _LOW
            scores = np.concatenate((best[mine], score), axis=1)
            ids = np.concatenate((who[mine], np.broadcast_to(vid[at], score.shape)), axis=1)
            ids = np.where(scores == _LOW, np.iinfo(np.int64).max, ids)
            take = np.lexsort((ids, -1 - scores), axis=1)[:, :k]  # -1 - x: the least number has no negative
            best[mine], who[mine] = np.take_along_axis(scores, take, 1), np.take_along_axis(ids, take, 1)
    where, column = np.nonzero(best > _LOW)
    return name[where], who[where, column], best[where, column]


_PLACES = "array<struct<pos:int,floor:bigint>>"


def _queries(row: dict, dims: int) -> np.ndarray:
    return _wide(row["q_width"], row["q_vectors"], len(row["q_ids"]) // 8, dims)


def _page_bounds(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The page's chunks and, for each query and chunk, the bound."""
    dims = max([row["q_dims"], *(b["dims"] for b in row["bounds"])])
    top, least = (np.stack([_wide(8, b[name], 1, dims)[0] for b in row["bounds"]]) for name in ("top", "least"))
    return np.array([b["chunk"] for b in row["bounds"]]), bounds(_queries(row, dims), top, least)


def _first_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, the chunk that bounds each query highest."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk, bound = _page_bounds(row)
            take = bound.argmax(axis=1)
            pos = np.arange(len(take), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(pos), pa.int64()), pa.array(pos), pa.array(chunk[take], pa.int64()), pa.array(bound[pos, take])], names=["part", "pos", "chunk", "bound"])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, the chunks whose bound reaches a query's floor, but the one that it was scored in."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("floor", pa.int64())]))
    for batch in batches:
        for row in batch.to_pylist():
            chunk, bound = _page_bounds(row)
            floor, done = np.full(len(bound), _LOW), np.zeros(len(bound), np.int64)
            for x in row["known"]:
                floor[x["pos"]], done[x["pos"]] = _LOW if x["floor"] is None else x["floor"], x["chunk"]
            wanted = (bound >= floor[:, None]) & (chunk[None, :] != done[:, None])
            some = np.flatnonzero(wanted.any(axis=0))
            places = [[{"pos": int(p), "floor": int(floor[p])} for p in np.flatnonzero(wanted[:, c])] for c in some]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(some), pa.int64()), pa.array(chunk[some], pa.int64()), pa.array(places, kind)], names=["part", "chunk", "places"])


def _scored(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, vid = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                dims = max(row["q_dims"], row["dims"], 1)
                pos = np.arange(len(qid)) if row["places"] is None else np.array([x["pos"] for x in row["places"]])
                low = None if row["places"] is None else np.array([_LOW if x["floor"] is None else x["floor"] for x in row["places"]])
                at, other, score = search(np.arange(len(pos)), _queries(row, dims)[pos], vid, _wide(row["width"], row["vectors"], len(vid), dims), k, low, qid[pos])
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(at), pa.int64()), pa.array(pos[at].astype(np.int32)), pa.array(qid[pos[at]]), pa.array(other), pa.array(score)], names=["part", "pos", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every` the k best other ids by inner product.

    Components count as floor(256 * x). Vectors that are null or hold a null or non-finite component, and null ids, take
    no part. Shorter vectors are continued with zeros. Equal rows of one id count once; rows of one id with different
    vectors are candidates each, and as queries are one that takes the best of all. Ties go to the smaller id. Scores
    beyond 64 bits are an error of the input (components above 10**8 or so). Other columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector")).where(F.col(id_col).isNotNull() & x.isNotNull() & finite)
    rows = rows.dropDuplicates(["vec_id", "vector"])
    number = vectors.count()
    dealt = rows.repartitionByRange(max(1, -(-number // CHUNK)), "vec_id").sortWithinPartitions("vec_id", "vector")
    ddl = "chunk long, dims int, width int, ids binary, vectors binary, top binary, least binary"
    index = save(dealt.mapInArrow(_chunks(CHUNK), ddl))
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = asked.repartitionByRange(max(1, -(-asked.count() // QUERIES)), "vec_id").sortWithinPartitions("vec_id", "vector")
    asked = asked.mapInArrow(_chunks(QUERIES), ddl).drop("top", "least")
    asked = save(asked.withColumnsRenamed({"chunk": "part", "dims": "q_dims", "width": "q_width", "ids": "q_ids", "vectors": "q_vectors"}))
    chunks, forward = index.count(), index.drop("top", "least")

    def searched(wanted: DataFrame) -> DataFrame:
        """The k best of each wanted (part, chunk, list of (pos, floor))."""
        return wanted.join(asked, "part").join(forward, "chunk").mapInArrow(_scored(k), "part long, pos int, query_id long, vec_id long, score long")

    if chunks <= 1:  # nothing to prune
        found = searched(asked.select("part").withColumn("chunk", F.lit(index.agg(F.max("chunk")).first()[0])).withColumn("places", F.lit(None).cast(_PLACES)))
    else:
        pages = -(-chunks // PAGE)
        paged = index.groupBy(F.pmod(F.xxhash64("chunk"), F.lit(pages)).cast("int").alias("page")).agg(F.collect_list(F.struct("chunk", "dims", "top", "least")).alias("bounds"))
        # a stated query set against the bounds of all chunks, in blocks
        met = asked.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).join(paged, "page")
        best = met.mapInArrow(_first_chunks, "part long, pos int, chunk long, bound double").groupBy("part", "pos").agg(F.max_by("chunk", F.struct("bound", "chunk")).alias("chunk"))
        best = save(best)
        places = F.collect_list(F.struct("pos", "floor")).alias("places")
        first = save(searched(best.withColumn("floor", F.lit(None).cast("long")).groupBy("part", "chunk").agg(places)))
        floors = first.groupBy("part", "pos").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        known = best.join(floors, ["part", "pos"], "left").groupBy("part").agg(F.collect_list(F.struct("pos", "floor", "chunk")).alias("known"))
        found = searched(met.join(known, "part").mapInArrow(_reached, f"part long, chunk long, places {_PLACES}")).unionByName(first)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    return f"""WITH rows_ AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM rows_ q JOIN rows_ c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
        SELECT * FROM ranked WHERE rank <= {k}"""
