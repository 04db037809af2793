"""Benchmark decontamination by pigeonhole edit matching.

A test item of n bytes of UTF-8 may be quoted with up to k = rate * n edits of a byte. Cut into k + 1
pieces, at least one piece is then in the text as it is. All pieces' beginnings are looked up at every position
of every whole text by a rolling hash, a hit is compared exactly, and the item is verified around it
with Myers's bit-parallel edit distance, the item's ends being fixed and the text's free.
Items and texts are compared with A-Z lower-cased and runs of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import _LOWER, _SPACE, steps, utf8

#: Shortest piece in bytes, edits for each byte of an item, bytes of items in one broadcast block.
PIECE, RATE, BLOCK_BYTES = 12, 0.08, 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, lower-cased, white space runs as one space and none at the ends; and their offsets."""
    raw, offsets = utf8(texts)
    if not len(raw):
        return raw, offsets
    space = _SPACE[raw]
    head = np.zeros(len(raw), bool)
    head[offsets[:-1][offsets[:-1] < len(raw)]] = True
    after = np.empty(len(raw), bool)
    after[0], after[1:] = True, space[:-1]
    keep = ~space | ~(after | head)  # the first white space of a run, but for one that begins a text
    kept = np.concatenate([[0], np.cumsum(keep)])
    data = np.where(space, 32, _LOWER[raw]).astype(np.uint8)[keep]
    new = kept[offsets]
    # a space that ends a text goes, too
    tail = new[1:][(new[1:] > new[:-1])] - 1
    last = np.zeros(len(data), bool)
    last[tail[data[tail] == 32]] = True
    gone = np.concatenate([[0], np.cumsum(last)])
    return data[~last], new - gone[new]


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of data[i : i + size] for every i, by doubling."""
    out, done = np.zeros(max(len(data) - size + 1, 0), np.uint64), 0
    block, width = data.astype(np.uint64) + np.uint64(1), 1
    power = int(_P)
    rest = size
    while rest and len(out):
        if rest & 1:
            part = block[done : done + len(out)]
            out = out * np.uint64(power) + part
            done += width
        rest >>= 1
        if rest:
            block = block[: len(block) - width] * np.uint64(power) + block[width:]
            width *= 2
            power = power * power % (1 << 64)
    return out * _P  # the upper bits are the good ones


class Myers:
    """Bit-parallel edit distance of a pattern to the substrings of a text that end at each place."""

    def __init__(self, pattern: bytes) -> None:
        self.size, self.mask, self.top = len(pattern), (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
        self.peq: dict[int, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: bytes) -> tuple[int, int]:
        """The least distance to a substring of text, and where the first such substring ends."""
        pv, mv, score, least, end = self.mask, 0, self.size, self.size, 0
        for j, c in enumerate(text):
            eq = self.peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & self.mask
            mh = pv & xh
            if ph & self.top:
                score += 1
            elif mh & self.top:
                score -= 1
            ph = ph << 1 & self.mask
            mh = mh << 1 & self.mask
            pv = mh | ~(xv | ph) & self.mask
            mv = ph & xv
            if score < least:
                least, end = score, j + 1
        return least, end


class Matcher:
    def __init__(self, items: list[tuple[int, bytes]], rate: float, piece: int) -> None:
        self.items, self.budget, places = items, [], {}
        for n, (_, text) in enumerate(items):
            budget = max(0, min(int(rate * len(text)), len(text) // piece - 1))
            self.budget.append(budget)
            cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    places.setdefault(b - a, []).append((n, a, b))
        self.patterns: dict[int, Myers] = {}
        self.known: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.groups = []
        sizes = sorted(places)
        # pieces are looked up by their first bytes; an item shorter than a piece, by all of them
        by_anchor: dict[int, list] = {}
        for size in sizes:
            by_anchor.setdefault(min(size, piece), []).extend(places[size])
        for anchor, rows in by_anchor.items():
            flat = np.frombuffer(b"".join(items[n][1][a : a + anchor] for n, a, _ in rows), np.uint8)
            keys = rolled(flat, anchor)[::anchor]
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << 20, bool)
            table[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.groups.append((anchor, keys[order], [rows[i] for i in order], table))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text number, item number, edits, end) of each text's best match of each item within its budget."""
        held, best = data.tobytes(), {}
        for anchor, keys, rows, table in self.groups:
            hashes = rolled(data, anchor)
            if not len(hashes):
                continue
            at = np.flatnonzero(table[(hashes >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(keys, hashes[at]), np.searchsorted(keys, hashes[at], side="right")
            there = high > low
            at, low, high = at[there], low[there], high[there]
            owner = np.searchsorted(offsets, at, side="right") - 1
            for p, t, a, b in zip(at.tolist(), owner.tolist(), low.tolist(), high.tolist(), strict=True):
                first, stop = int(offsets[t]), int(offsets[t + 1])
                for n, start, end in rows[a:b]:
                    text, budget = self.items[n][1], self.budget[n]
                    if p + end - start > stop or held[p : p + end - start] != text[start:end]:
                        continue
                    seen = best.get((t, n))
                    if seen and (seen[0] == 0 or p < seen[1]):
                        continue
                    low_edge = max(first, p - start - budget)
                    window = held[low_edge : min(stop, p - start + len(text) + budget)]
                    edits, reach = self.known.get((n, window)) or self._verify(n, window)
                    if edits <= budget and (not seen or edits < seen[0]):
                        best[t, n] = (edits, low_edge + reach)
        return [(t, n, edits, end) for (t, n), (edits, end) in best.items()]

    def _verify(self, n: int, window: bytes) -> tuple[int, int]:
        if len(self.known) > 100_000:
            self.known.clear()
        text = self.items[n][1]
        at = window.find(text)
        if at < 0 and n not in self.patterns:
            self.patterns[n] = Myers(text)
        out = self.known[n, window] = (0, at + len(text)) if at >= 0 else self.patterns[n].best(window)
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, all texts of an id in one block. Only one block is held by the driver at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        yield [(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).collect()]


def _matcher(block: list[tuple[int, str]], rate: float, piece: int) -> Matcher:
    data, offsets = normal(pa.array([t for _, t in block], pa.string()))
    held = data.tobytes()
    return Matcher([(i, held[a:b]) for (i, _), a, b in zip(block, offsets.tolist(), offsets[1:].tolist(), strict=False) if b > a], rate, piece)


def find_quotes(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, piece: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits: one row for each item that a text holds within the item's edit budget.

    Items are a stated set, broadcast in blocks of bounded size against all whole texts; items with a
    null id or a null or blank text take no part, nor do null texts. An item shorter than two pieces
    must be there exactly. Repeated rows of a text give repeated rows; repeated items, and items of equal
    id, give one row with the fewest edits. Empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    out = spark.createDataFrame([], "doc_id long, item_id long, edits int")
    for block in _blocks(items, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(sorted(set(block)))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value, rate, piece)
            for batch in steps(batches):
                found: dict[tuple[int, int], int] = {}
                for t, n, edits, _ in matcher.find(*normal(batch.column("text"))):
                    key = (t, matcher.items[n][0])
                    found[key] = min(edits, found.get(key, edits))
                if found:
                    ids = batch.column("doc_id")
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([t for t, _ in found], pa.int64())), pa.array([i for _, i in found], pa.int64()), pa.array(list(found.values()), pa.int32())], ["doc_id", "item_id", "edits"])

        out = out.unionByName(rows.mapInArrow(work, "doc_id long, item_id long, edits int"))
    return out


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_ids (rising), least_edits of every document that quotes an item."""
    found = find_quotes(docs, items, **options)
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.min("edits").alias("least_edits"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, piece: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text quotes no item, all of them with the same columns.

    Null and empty texts stay, repeated rows all stay or all go, ids play no part. With no items every
    row stays; an empty table gives an empty result.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for block in _blocks(items, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(sorted(set(block)))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value, rate, piece)
            for batch in steps(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in matcher.find(*normal(batch.column(at)))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
