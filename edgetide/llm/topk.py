"""Exact top-k inner product search by block-at-a-time pruning.

Vectors are cut into blocks of consecutive rows (document ranges). A block has a forward index, the matrix of its
vectors, and for every term (dimension) the largest and the smallest value in it. For a query the sum over terms of
the larger of weight * largest and weight * smallest bounds every score in the block. Each query visits blocks in
order of that bound, scores a block's vectors from the forward index, and stops at the first block whose bound is
below its k-th best score so far; a block that equals it is still visited, for ties go to the smaller id.

Queries are taken in blocks of at most ``query_block`` rows; each is broadcast to the shards in turn. A task takes its
vectors ``shard`` at a time and carries each query's k best from one to the next, so that later ones are pruned by them;
it returns k rows a query, and those are merged by a window over the query's row.

Scores are exact: where products of the rows' largest values could leave the whole numbers that doubles hold, those rows
alone are multiplied as Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgetide.llm.runtime import prepare, stage

#: Below this sums of products of whole numbers are exact in doubles.
EXACT = 2.0**53


def quantised(vectors: DataFrame, key: str, column: str, scale: int = 256) -> DataFrame:
    """(key, vector): floor(scale * x) of each component as double; vectors that are null or hold null or non-finite parts go."""
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    # from 2**52 on a double is whole already, and a long could not hold it
    floor = lambda v: F.when(F.abs(v * scale) >= 2.0**52, v * scale).otherwise(F.floor(v * scale).cast("double"))
    return vectors.where(whole).select(F.col(key).cast("long").alias("id"), F.transform(x, floor).alias("vector"))


def numbered(vectors: DataFrame) -> DataFrame:
    """vectors (id, vector), staged, with ``row``, which tells rows of one id apart."""
    prepare(vectors.sparkSession)
    return stage(vectors.where("id is not null").select("id", "vector").withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, rows and a dense matrix; shorter vectors are filled up with zeros."""
    ids, rows = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("id", "row"))
    lists = [b.column("vector") for b in batches]
    lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]) if lists else np.zeros(0, int)
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])
    width = int(lengths.max()) if len(lengths) else 0
    if width and (lengths == width).all():
        return ids, rows, flat.reshape(-1, width)
    out = np.zeros((len(ids), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return ids, rows, out


def wider(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Blocks:
    """Forward indexes and term bounds of the blocks of a shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, size: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.vectors, self.size = ids[order], rows[order], vectors[order], size
        first = np.arange(0, len(ids), size)
        self.first = np.r_[first, len(ids)]
        self.most, self.least = np.maximum.reduceat(self.vectors, first, axis=0), np.minimum.reduceat(self.vectors, first, axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.most.T + down @ self.least.T


def search(q_rows: np.ndarray, q: np.ndarray, blocks: Blocks, best: np.ndarray, who: np.ndarray) -> int:
    """Bring in the best rows of a shard, self left out: scores (queries x k, best first, -inf where there are fewer) and
    ids. Returns how many pairs of a query and a block were scored."""
    n, k, scored = len(q_rows), best.shape[1], 0
    bounds = blocks.bounds(q)
    order = np.argsort(-bounds, axis=1, kind="stable")
    ranked = np.take_along_axis(bounds, order, 1)
    at, step = 0, 1
    active = np.arange(n)
    while len(active) and at < order.shape[1]:
        turn = slice(at, at + step)
        chosen, bound = order[active][:, turn], ranked[active][:, turn]
        row, col = np.nonzero(bound >= best[active, -1][:, None])
        block = chosen[row, col]
        by = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(block[by]) != 0]) if len(by) else []
        for s, e in zip(cuts, [*cuts[1:], len(by)]):
            b, mine = int(block[by[s]]), active[row[by[s:e]]]
            lo, hi = blocks.first[b], blocks.first[b + 1]
            score = q[mine] @ blocks.vectors[lo:hi].T
            scored += len(mine)
            ids = blocks.ids[lo:hi]
            score[q_rows[mine][:, None] == blocks.rows[lo:hi][None, :]] = -np.inf
            both = np.concatenate([best[mine], score], axis=1)
            names = np.concatenate([who[mine], np.broadcast_to(ids, (len(mine), len(ids)))], axis=1)
            # ids within a block ascend, but earlier finds may have any id
            top = np.lexsort((names, -both), axis=1)[:, :k] if both.shape[1] <= 4 * k else _top(both, names, k)
            best[mine], who[mine] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        at += step
        step = min(step * 2, 64)
        if at < order.shape[1]:
            active = active[ranked[active, at] >= best[active, -1]]
    return scored


def _top(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties by name: those above the k-th value and its ties are ordered."""
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    out = np.empty((len(score), k), np.int64)
    for i in range(len(score)):
        c = np.flatnonzero(score[i] >= kth[i])
        out[i] = c[np.lexsort((names[i, c], -score[i, c]))[:k]]
    return out


def ordered_text(x: int) -> str:
    """A whole number as text that sorts as it does; up to 9999 digits."""
    digits = str(abs(x))
    if x >= 0:
        return f"1{len(digits):04}{digits}"
    return f"0{9999 - len(digits):04}" + "".join(chr(105 - ord(c)) for c in digits)


LIMIT = (1 << 63) - 1
FOUND = "query_row long, query_id long, vec_id long, score long, large string"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["query_row", "query_id", "vec_id", "score", "large"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 4 else pa.int64()) for i in range(5)], names=names)


def _exact(q_ids, q_rows, q, ids, rows, vectors, k: int, width: int = 256) -> Iterator[tuple]:
    """The best k of the vectors for each query by products of Python integers, some vectors at a time."""
    for i, r, x in zip(q_ids, q_rows, q):
        x = np.array([int(v) for v in x], object)
        kept: list[tuple] = []
        for at in range(0, len(ids), width):
            y = np.array([[int(v) for v in z] for z in vectors[at : at + width]], object)
            scores = y @ x if y.size else [0] * len(y)
            kept = sorted(kept + [(-s, int(j)) for s, j, o in zip(scores, ids[at : at + width], rows[at : at + width]) if o != r])[:k]
        for s, j in kept:
            # equal longs at either limit are told apart by the text
            yield int(r), int(i), j, max(-LIMIT - 1, min(LIMIT, -s)), ordered_text(-s) if abs(s) >= LIMIT else None


def _shard(shared, k: int, block: int, shard: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_rows, q = shared.value
        best, who = np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max)

        def take(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rows, vectors = matrix(held)
            width = max(q.shape[1], vectors.shape[1])
            a, b = wider(q, width), wider(vectors, width)
            # rows whose values are at most this have exact products with each other
            most = np.sqrt(EXACT / max(1, width)) - 1
            fine_q, fine = (np.abs(x).max(axis=1, initial=0) <= most for x in (a, b))
            if fine_q.any() and fine.any():
                mine, names = best[fine_q], who[fine_q]
                search(q_rows[fine_q], a[fine_q], Blocks(ids[fine], rows[fine], b[fine], block), mine, names)
                best[fine_q], who[fine_q] = mine, names
            for some, others in ((fine_q, ~fine), (~fine_q, np.ones(len(fine), bool))):
                if some.any() and others.any():
                    found = [*_exact(q_ids[some], q_rows[some], a[some], ids[others], rows[others], b[others], k)]
                    if found:
                        yield _packed(found)

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= shard:
                yield from take(held)
                held, n = [], 0
        if held:
            yield from take(held)
        row, col = np.nonzero(best > -np.inf)
        columns = [pa.array(q_rows[row]), pa.array(q_ids[row]), pa.array(who[row, col]), pa.array(best[row, col].astype(np.int64)), pa.nulls(len(row), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "vec_id", "score", "large"])

    return each


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 64, shard: int = 16_384, query_block: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest inner products of each query among all other rows.

    vectors: (id, vector of whole numbers as double, row), as ``numbered`` gives; queries are rows of the same kind, and a
    row is no candidate for itself. Ties go to the smaller id. Vectors of unequal length count as filled up with zeros;
    an empty vector scores 0. Scores are ranked exactly; beyond a long they are given as the nearest long. Rows that
    share an id are each a query and a candidate, also for each other; null ids are left out. Fewer candidates than k
    give fewer rows; an empty table gives none.
    """
    spark = prepare(vectors.sparkSession)
    n = queries.count()
    parts = max(1, -(-n // query_block)) * 2 if n > query_block else 1
    dealt = stage(queries.where("id is not null").select("id", "row", "vector").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))), "queries")
    found = None
    for part in range(parts):
        rows = [b for b in dealt.where(F.col("part") == part).select("id", "row", "vector").toArrow().to_batches() if b.num_rows]
        if not rows:
            continue
        ids, own, q = matrix(rows)
        shared = spark.sparkContext.broadcast((ids.astype(np.int64), own.astype(np.int64), q))
        got = stage(vectors.select("id", "row", "vector").mapInArrow(_shard(shared, k, block, shard), FOUND), "topk-part")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("large"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
