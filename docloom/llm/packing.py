"""Mixture-controlled packing of documents into fixed token windows by deficit round-robin.

Texts are encoded once and their ids written; documents are dealt by a hash of their row number to
shards of bounded size. In a shard each source has a
queue. For every mixture window (some sequences long) a source is owed its share of the window plus
the deficit that it carries; its queue pays with tokens, documents being cut freely, and what it could
not pay stays as deficit. Queues that ran dry leave their share to the others. The windows run on into
each other and are cut into sequences, so only a shard's last sequence can be short. A shard starts
with the deficits that the shards before it leave behind: their tokens by source against the target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .tokens import encoder, with_end
from .totals import with_before
from .vectext import steps

#: Tokens of a shard (it is held in one worker as 16- or 32-bit ids), sequences of a mixture window, and partitions that shards are dealt to at most.
SHARD_TOKENS, WINDOW, MOST_PARTS = 2 << 20, 64, 1 << 14
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def schedule(source: np.ndarray, size: np.ndarray, share: np.ndarray, carry: np.ndarray, window: int) -> np.ndarray:
    """Rows (document, first token, tokens) in packing order.

    source: each document's queue; size: its tokens; share: each queue's target; carry: its deficit in tokens.
    """
    n = len(share)
    order = np.argsort(source, kind="stable")
    run = np.concatenate([[0], np.cumsum(size[order])])  # tokens of all queues end to end
    bounds = np.searchsorted(source[order], np.arange(n + 1))
    at, stop = run[bounds[:-1]].copy(), run[bounds[1:]]
    deficit = carry.astype(float).copy()
    out = []
    while True:
        live = at < stop
        if not live.any():
            break
        weight = np.where(live, share, 0.0)
        weight = weight / weight.sum() if weight.sum() > 0 else live / live.sum()
        left, turn = window, 0
        while left > 0 and (at < stop).any():
            live = at < stop
            if turn == 0:
                deficit = np.where(live, deficit + weight * window, 0.0)
            owed = np.minimum(np.floor(np.maximum(deficit, 0)), stop - at).astype(np.int64)
            if not owed.any():  # what is left goes to the live queues that are owed most
                owed[np.argmax(np.where(live, deficit, -np.inf))] = 1 if turn == 0 else left
                owed = np.minimum(owed, stop - at)
            for q in np.flatnonzero(owed):
                take = min(int(owed[q]), left)
                if take:
                    out.append((at[q], at[q] + take))
                    at[q] += take
                    deficit[q] -= take
                    left -= take
            turn += 1
    if not out:
        return np.zeros((0, 3), np.int64)
    # Cut the taken stretches at the documents' borders.
    taken = np.array(out, np.int64)
    first, last = np.searchsorted(run, taken[:, 0], side="right") - 1, np.searchsorted(run, taken[:, 1], side="left") - 1
    count = last - first + 1
    doc = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    low, high = np.maximum(run[doc], np.repeat(taken[:, 0], count)), np.minimum(run[doc + 1], np.repeat(taken[:, 1], count))
    rows = np.stack([order[doc], low - run[doc], high - low], axis=1)[high > low]
    # Stretches of one document that follow each other are one.
    joined = np.zeros(len(rows), bool)
    joined[1:] = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1] + rows[:-1, 2])
    group = np.cumsum(~joined) - 1
    keep = rows[~joined]
    keep[:, 2] = np.bincount(group, weights=rows[:, 2]).astype(np.int64)
    return keep


def cut(rows: np.ndarray, length: int) -> np.ndarray:
    """Rows (document, start, tokens, sequence, offset): the stream of stretches cut at every length tokens."""
    end = np.cumsum(rows[:, 2])
    total = int(end[-1]) if len(end) else 0
    edges = np.union1d(np.concatenate([[0], end]), np.arange(0, total, length)).astype(np.int64)
    low, high = edges[:-1], edges[1:]
    row = np.searchsorted(end, low, side="right")
    begin = rows[row, 1] + low - (end[row] - rows[row, 2]) if total else low
    return np.stack([rows[row, 0] if total else low, begin, high - low, low // length, low % length], axis=1)


def shorter(ids: memoryview) -> bytes:
    """Little-endian 32-bit ids in a byte string: a width of 2 or 4 bytes, and the ids in that width."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else b"\4" + wide.tobytes()


def longer(held: bytes) -> np.ndarray:
    """The ids of shorter(), in their width."""
    return np.frombuffer(held, "<u2" if held[0] == 2 else "<u4", offset=1)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = 1024, end_id: int = 0, shares: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    shares: target proportion of each source in tokens; by default its share of the corpus's tokens. Every
    token of every row is in exactly one piece, whatever the shares: they rule the order. A null text counts
    as empty (one piece, the end id); a null source is a source of its own; rows with equal or null
    ids are documents of their own, dealt to shards like any others. sequence_id is unique, not dense: the
    shard times 2^32 plus the number in the shard. An empty table gives an empty result. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in steps(batches, keeps=True):
            ids, offsets = with_end(*encoder(tokenizer).encode(batch.column("text").to_pylist()), end_id)
            held, at = memoryview(ids.astype("<u4")).cast("B"), (4 * offsets).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(batch.num_rows)), batch.column("doc_id"), batch.column("source"), pa.array(np.diff(offsets)), pa.array([shorter(held[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())],
                ["row", "doc_id", "source", "n", "ids"],
            )
            row += batch.num_rows

    rows = materialize(texts.mapInArrow(encode, "row long, doc_id long, source string, n long, ids binary"), "packing-ids")
    total = rows.agg(F.sum("n")).first()[0] or 0
    n_shards = max(1, -(-total // shard_tokens))
    n_parts = min(n_shards, MOST_PARTS)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int"))

    by_source = materialize(rows.groupBy("shard", "source").agg(F.sum("n").alias("n")), "packing-sources")
    spent = with_before(by_source, "shard", "n", ["source"]).select("shard", "source", F.col("before").alias("spent"))
    before = with_before(by_source.groupBy("shard").agg(F.sum("n").alias("n")), "shard", "n").select("shard", F.col("before").alias("all"))
    if shares is None:
        share = by_source.groupBy("source").agg((F.sum("n") / F.lit(float(max(total, 1)))).alias("share"))
    else:
        share = spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "source string, share double")
    owed = spent.alias("b").join(before, "shard").join(share.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")), "left")
    share = F.coalesce("share", F.lit(0.0))
    heads = owed.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("b.source").alias("source"), F.lit(None).cast("binary").alias("ids"), share.alias("share"), (share * F.col("all") - F.col("spent")).alias("carry"))
    none = F.lit(None).cast("double")
    bodies = rows.select("shard", F.lit(1).alias("kind"), "row", "doc_id", "source", "ids", none.alias("share"), none.alias("carry"))
    dealt = heads.unionByName(bodies).repartitionById(n_parts, F.pmod("shard", F.lit(n_parts))).sortWithinPartitions("shard", "kind", "doc_id", "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, ids, sources, parts = None, {}, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            names = list(heads)
            number = {s: i for i, s in enumerate(names)}
            each = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts)
            begin = np.cumsum(each) - each
            queue = np.array([number[s] for s in sources], np.int64)
            pieces = cut(schedule(queue, each, np.array([heads[s][0] for s in names]), np.array([heads[s][1] for s in names]), window * length), length)
            at = begin[pieces[:, 0]] + pieces[:, 1]
            crc = [zlib.crc32(flat[a:b].astype("<u4")) for a, b in zip(at.tolist(), (at + pieces[:, 2]).tolist(), strict=True)]
            docs_of = pa.array(pieces[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(docs_of), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array(each[pieces[:, 0]]), pa.array(pieces[:, 3] + (now << 32)), pa.array(pieces[:, 4]), pa.array(sources, pa.string()).take(docs_of)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

        for batch in steps(batches, "ids"):
            for shard, kind, doc_id, source, held, share, carry in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "doc_id", "source", "ids", "share", "carry")), strict=True):
                if shard != now:
                    yield from flush()
                    now, heads, ids, sources, parts = shard, {}, [], [], []
                if kind:
                    ids.append(doc_id)
                    sources.append(source)
                    parts.append(longer(held))
                else:
                    heads[source] = (share, carry)
        yield from flush()

    return dealt.mapInArrow(work, _OUT)
