"""Exact top-k inner-product search by MaxScore.

Every dimension is a pair of terms, "component above zero" and "component below zero". A query with
weight w on a dimension uses the term of w's sign, so a posting's impact w * x is positive and the
score never exceeds the sum of the impacts of the terms whose postings hold the vector. Each task is
one shard: it keeps the largest impact of each term, splits a query's terms by these bounds into
essential and non-essential ones, accumulates the essential dimensions, and probes the others in
falling order of bound only for vectors that can still reach the k-th best score. Ties stay
competitive. The shards' k best are merged by one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Vectors in one shard block, and queries in one broadcast block (64 dimensions: 8 MB).
SHARD_ROWS, QUERY_BLOCK = 8192, 16384
#: Beyond this, sums of products could leave the integers that float64 holds exactly.
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds finite components only, as `v` in doubles."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(vector).isNotNull()).where(~bad).withColumn("v", F.transform(vector, lambda x: x.cast("double")))


class Shard:
    """Postings bounds and columns of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.top = np.maximum(self.columns.max(1), 0)  # impact bound of the term "above zero", per unit of weight
        self.low = np.minimum(self.columns.min(1), 0)

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k best (id, score) with a score of at least floor, but for rows whose id is own."""
        bound = np.where(query > 0, query * self.top, query * self.low)
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], np.zeros(1, bound.dtype)])  # what the terms from i on can add at most
        allowed = np.flatnonzero(self.ids != own)
        if not allowed.size:
            return self.ids[:0], np.zeros(0)
        seed = allowed[: max(4 * k, 64)]  # sets the first threshold
        threshold = max(floor, self._kth(query @ self.columns[:, seed], k))
        essential = int(np.searchsorted(-rest, -threshold, side="right")) if threshold > 0 else len(query)
        essential = min(max(essential, 1), len(query))
        first = order[:essential]
        score = query[first] @ self.columns[first]
        threshold = max(threshold, self._kth((score + self._sure(query, order[essential:]))[allowed], k))
        alive = allowed[score[allowed] + rest[essential] >= threshold]
        score = score[alive]
        for i in range(essential, len(query)):
            d = order[i]
            if query[d] == 0:
                continue  # others with a bound of 0 may stand behind it
            score = score + query[d] * self.columns[d, alive]
            keep = score + rest[i + 1] >= threshold
            if not keep.all():
                alive, score = alive[keep], score[keep]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[best]], score[best]

    def _sure(self, query: np.ndarray, terms: np.ndarray) -> float | int:
        """What the given terms take away at most: a lower bound of their sum."""
        q = query[terms]
        return np.where(q > 0, q * self.low[terms], q * self.top[terms]).sum()

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> float | int:
        if len(scores) < k:
            return -np.inf
        return (np.sort(scores) if scores.dtype == object else np.partition(scores, len(scores) - k))[len(scores) - k]


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles: as doubles where these are whole numbers that products can be summed of, else as Python's integers."""
    with np.errstate(over="ignore"):
        out = np.floor(256.0 * values)
    if np.isfinite(out).all():
        return out
    return np.array([math.floor(256 * Fraction(x)) for x in values.ravel().tolist()], object).reshape(values.shape)


def _exact(a: np.ndarray) -> np.ndarray:
    return a if a.dtype == object else np.array([int(x) for x in a.ravel().tolist()], object).reshape(a.shape)


def _matrix(parts: list[pa.RecordBatch], width: int) -> np.ndarray:
    flat = [p.column("v").flatten().to_numpy(zero_copy_only=False) for p in parts]
    return whole(np.concatenate(flat).reshape(sum(p.num_rows for p in parts), width))


def _peak(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max())), 1) if values.size else 1


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best vectors by integer inner product.

    Queries are a stated set: they are sent to the shards in blocks of query_block rows, so that what
    is broadcast is bounded whatever their number. Vectors that are null or hold a null or non-finite
    component take no part, nor do those of another length than the query. A query with no candidate
    has no row; an empty table gives an empty result. Repeated ids: the query set keeps one row of an
    id, candidates keep all; rows with the query's own id are never its candidates. Ties go to the
    smaller id. Components of any finite size are computed exactly; scores beyond the 64-bit integers
    are held at the largest or smallest of these. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    base = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("e")).where(F.col("id").isNotNull()), "e").select("id", "v")
    asked = usable(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("e")).where(F.col("id").isNotNull()), "e").select("id", "v").dropDuplicates(["id"])
    cuts = [None]
    n = asked.count()
    if n > query_block:
        cuts = asked.approxQuantile("id", [i / -(-n // query_block) for i in range(1, -(-n // query_block))], 0.001)
        cuts = [None, *sorted(set(cuts))]
    out = None
    for i, low in enumerate(cuts):
        block = asked
        if low is not None:
            block = block.where(F.col("id") > F.lit(int(low)))
        if i + 1 < len(cuts):
            block = block.where(F.col("id") <= F.lit(int(cuts[i + 1])))
        sent = spark.sparkContext.broadcast([(r.id, list(r.v)) for r in block.collect()])

        def shard(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked_by_width: dict[int, list[tuple[int, list[int]]]] = {}
            for q, v in sent.value:
                asked_by_width.setdefault(len(v), []).append((q, v))
            best: dict[int, list[tuple[int, int]]] = {}

            def flush(width: int, parts: list[pa.RecordBatch]) -> None:
                rows = asked_by_width.get(width, [])
                ids, held = np.concatenate([p.column("id").to_numpy() for p in parts]), _matrix(parts, width)
                asked = whole(np.array([v for _, v in rows], dtype=float).reshape(len(rows), width))
                if width * _peak(held) * _peak(asked) >= EXACT:
                    held, asked = _exact(held), _exact(asked)
                block = Shard(ids, held)
                for (q, _), v in zip(rows, asked, strict=True):
                    got = best.get(q, [])
                    found, scores = block.search(v, q, k, got[-1][0] if len(got) >= k else -np.inf)
                    best[q] = sorted(got + [(int(s), int(x)) for x, s in zip(found, scores, strict=True)], key=lambda x: (-x[0], x[1]))[:k]

            held: dict[int, list[pa.RecordBatch]] = {}
            for batch in batches:
                widths = np.diff(batch.column("v").offsets.to_numpy())
                for width in np.unique(widths):
                    part = batch.filter(pa.array(widths == width))
                    for at in range(0, part.num_rows, shard_rows):
                        held.setdefault(int(width), []).append(part.slice(at, shard_rows))
                        if sum(p.num_rows for p in held[int(width)]) >= shard_rows:
                            flush(int(width), held.pop(int(width)))
            for width, parts in held.items():
                flush(width, parts)
            rows = [(q, x, min(max(s, LEAST), MOST)) for q, found in best.items() for s, x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

        part = base.mapInArrow(shard, schema)
        if len(cuts) > 1:  # one block at a time: neither driver nor workers hold two
            part = materialize(part, "top-k")
            sent.unpersist()
        out = part if out is None else out.unionByName(part)
    # (-1 - score) rises as the score falls, and has a value for every score
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((F.lit(-1) - F.col("score")).alias("s"), F.col("vec_id").alias("x")))), 1, k)
    merged = out.groupBy("query_id").agg(ranked.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.x").alias("vec_id"), (F.lit(-1) - F.col("hit.s")).alias("score"))
