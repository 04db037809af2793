"""Language-model scoring with a log-frequency Bloom filter.

The training texts' words and word pairs are counted. A count is kept as its level, exact for small
counts and logarithmic beyond: the filter holds (n-gram, 1), ..., (n-gram, level), so probing rising
levels until one misses gives the quantised count, and a false hit can only raise it by a level. The
hash space is cut into ranges; a range's n-grams live in a block of the filter of their own, which one
task builds. The number of ranges grows with the text, so that a block stays bounded and the filter as
a whole does not. It is never in one place: chunks of texts send their distinct n-grams, with how
often training texts hold them, to the ranges' tasks, which build their blocks of all chunks' counts,
probe them and send the levels back.

The probability of a word after another one is that of the pair's count, smoothed by the word's own:
(c(before, word) + PRIOR p(word)) / (c(before) + PRIOR), with p(word) = (c(word) + 1) / (Q + V + 1),
all counts as the filter has them, V the number of known words and Q the sum of their counts. A pair
counts no more than its words do. For every context the probabilities of all known words and one
unknown word sum to 1, but for what quantising the counts adds or takes (at most a step, 2 % by
default) and for the filter's false hits.

The base score needs exact counts. The ranges' tasks have them, by 128 bits of hash, and send them
back with the levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .vectext import Words, gives_back, mix, steps

END = np.uint64(0x5851F42D4C957F2D)
#: Counts that have a level each, ratio of the levels beyond, hash functions, bits for each held level.
EXACT, BASE, HASHES, BITS = 16, 1.02, 5, 14
#: Tokens of a range, tokens after which a chunk of texts asks for its n-grams' counts, n-grams probed at once, weight of the word's own probability.
RANGE_TOKENS, CHUNK, FLUSH, PRIOR = 3 << 19, 1 << 20, 1 << 19, 8.0
#: Partitions that ranges or chunks are dealt to at most, and chunks of a partition.
MOST_PARTS, PART_CHUNKS = 1 << 14, 2
_PAIR, _LEVEL = np.uint64(0x2545F4914F6CDD1D), 0x9E6C63D0676A9A99
#: N-grams are held in the filter by the upper 48 bits of their hash.
_KEPT = np.uint64(16)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, second hash) of every text's words and its end."""
    words, n = Words(texts), len(texts)
    at = np.searchsorted(words.text, np.arange(n), side="right")
    return np.insert(words.text, at, np.arange(n)), np.insert(words.hash, at, END), np.insert(words.check, at, END)


def planes(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned integers as bytes, all first ones, then all second ones and so on."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.ravel()


def pack_ints(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned integers, each with its width in bytes, compressed."""
    body = np.concatenate([planes(v, w) for v, w in columns])
    head = np.array([len(columns), body.size, *(x for v, w in columns for x in (len(v), w))], "<u8")
    return head.tobytes() + pa.compress(body.tobytes(), "zstd", asbytes=True)


def unpack_ints(blob: bytes) -> list[np.ndarray]:
    """The columns of pack_ints, as 64-bit integers."""
    n, total = np.frombuffer(blob, "<u8", 2).tolist()
    shape = np.frombuffer(blob, "<u8", 2 * n, 16).reshape(n, 2).tolist()
    body = np.frombuffer(pa.decompress(blob[16 + 16 * n :], total, "zstd", asbytes=True), np.uint8) if total else np.zeros(0, np.uint8)
    out, at = [], 0
    for size, width in shape:
        out.append(np.ascontiguousarray(body[at : at + size * width].reshape(width, size).T).view(f"<u{width}").ravel().astype(np.uint64))
        at += size * width
    return out


def _gaps(key: np.ndarray) -> np.ndarray:
    return np.diff(key, prepend=np.uint64(0))


def _thresholds() -> np.ndarray:
    """The least count of each level from 1 on."""
    out = list(range(1, EXACT + 1))
    while out[-1] < 1 << 50:
        out.append(max(out[-1] + 1, int(out[-1] * BASE)))
    return np.array(out, np.int64)


LEAST = _thresholds()


def level_of(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, count, side="right")


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    level = np.minimum(level, len(LEAST) - 1)
    return np.where(level > 0, (LEAST[np.maximum(level, 1) - 1] + LEAST[level] - 1) / 2, 0.0)


class Filter:
    """A block of the filter: bits at the places that hash functions give each held (key, level)."""

    def __init__(self, key: np.ndarray, level: np.ndarray) -> None:
        """As large as the keys' levels need."""
        self.size = max(1024, BITS * int(level.sum()))
        bits = np.zeros(self.size, bool)
        rest, least = key, level
        for step in range(1, int(level.max(initial=0)) + 1):
            on = least >= step
            rest, least = rest[on], least[on]
            for at in self.places(rest, step):
                bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")

    def places(self, key: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = mix(key * _PAIR + np.uint64(level * _LEVEL & 0xFFFFFFFFFFFFFFFF))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for _ in range(HASHES):
            yield (h % np.uint64(self.size)).astype(np.int64)
            h = h + step * _PAIR

    def level(self, key: np.ndarray) -> np.ndarray:
        """The highest level up to which every level of the key is held, found by rising probes."""
        out, alive, step = np.zeros(len(key), np.int64), np.arange(len(key)), 1
        while len(alive) and step < len(LEAST):
            held, now = np.ones(len(alive), bool), key[alive]
            for at in self.places(now, step):
                held &= self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            alive = alive[held]
            out[alive] = step
            step += 1
        return out


class Probe:
    """Levels by probing a block; keys that many chunks ask for are probed once."""

    def __init__(self, block: Filter, often: np.ndarray) -> None:
        self.block, self.key = block, np.sort(often)
        self.known = block.level(self.key)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return self.block.level(key)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        out, rest = self.known[at], np.flatnonzero(self.key[at] != key)
        out[rest] = self.block.level(key[rest])
        return out


class Chunk:
    """Some texts' tokens as places among their distinct words, and their distinct word pairs."""

    def __init__(self, size: np.ndarray, train: np.ndarray, key: np.ndarray, check: np.ndarray, back: np.ndarray) -> None:
        self.size, self.train, self.key, self.check, self.back = size, train, key, check, back

    @classmethod
    def of(cls, size: np.ndarray, train: np.ndarray, h: np.ndarray, g: np.ndarray) -> Chunk:
        key, first, back = np.unique(h, return_index=True, return_inverse=True)
        if (g[first][back] != g).any():  # words that share the first half of their hashes
            both, back = np.unique(np.stack([h, g], 1), axis=0, return_inverse=True)
            return cls(size, train, both[:, 0].copy(), both[:, 1].copy(), back)
        return cls(size, train, key, g[first], back)

    def packed(self) -> bytes:
        return pack_ints((self.size, 4), (self.train, 1), (_gaps(self.key), 8), (self.check, 8), (self.back, 4))

    @classmethod
    def unpacked(cls, blob: bytes) -> Chunk:
        size, train, gaps, check, back = unpack_ints(blob)
        return cls(size.astype(np.int64), train.astype(bool), np.cumsum(gaps, dtype=np.uint64), check, back.astype(np.int64))

    def grams(self) -> None:
        """Set the filter's keys of words and pairs, the tokens' places of the word before and the pair, and training counts."""
        v = len(self.key)
        end = int(np.flatnonzero((self.key == END) & (self.check == END))[0])
        self.before = np.concatenate([[end], self.back[:-1]])
        self.before[np.cumsum(self.size) - self.size] = end
        code, self.pair = np.unique(self.before * v + self.back, return_inverse=True)
        learned = np.repeat(self.train, self.size)
        self.word_key = mix(self.key) >> _KEPT
        self.pair_key = mix(self.key[code // v] * _PAIR + self.key[code % v]) >> _KEPT
        self.word_count = np.bincount(self.back[learned], minlength=v)
        self.pair_count = np.bincount(self.pair[learned], minlength=len(code))

    def ranges(self, n_ranges: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each range that has some of the n-grams its number, its words and its pairs, in the order they are sent."""
        of = [range_of(key, n_ranges) for key in (self.word_key, self.pair_key)]
        order = [np.argsort(of[0], kind="stable"), np.lexsort((self.pair_key, of[1])) if n_ranges > 1 << 16 else np.argsort(of[1].astype(np.uint64) << np.uint64(48) | self.pair_key)]
        of = [r[o] for r, o in zip(of, order, strict=True)]  # words are sorted by key already
        edges = [r[np.flatnonzero(np.diff(r, prepend=-1))] for r in of]
        some = np.union1d(*edges)
        cuts = [(np.searchsorted(r, some), np.searchsorted(r, some, side="right")) for r in of]
        for i, r in enumerate(some.tolist()):
            yield r, *(o[low[i] : high[i]] for o, (low, high) in zip(order, cuts, strict=True))


def range_of(key: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((key >> np.uint64(24)) % np.uint64(n_ranges)).astype(np.int64)


class Counts:
    """Counts by one or two key columns, put together from many sorted pieces."""

    def __init__(self, width: int) -> None:
        self.keys, self.count, self.loose, self.size = [np.zeros(0, np.uint64)] * width, np.zeros(0, np.int64), [], 0

    def add(self, *piece: np.ndarray) -> None:
        """Key columns and counts; keys whose count is 0 are left out."""
        on = piece[-1] > 0
        if on.any():
            self.loose.append([c[on] for c in piece])
            self.size += int(on.sum())
            if self.size > max(len(self.count), FLUSH):  # so that every key is sorted a few times only
                self.settle()

    def settle(self) -> None:
        if not self.loose:
            return
        *keys, count = (np.concatenate(c) for c in zip([*self.keys, self.count], *self.loose, strict=True))
        order = np.lexsort(keys[::-1])
        keys, count = [k[order] for k in keys], count[order].astype(np.int64)
        new = np.ones(len(count), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        first = np.flatnonzero(new)
        self.keys, self.count, self.loose, self.size = [k[first] for k in keys], np.add.reduceat(count, first), [], 0

    def find(self, *keys: np.ndarray) -> np.ndarray:
        """The counts of the keys, 0 where there is none."""
        out = np.zeros(len(keys[0]), np.int64)
        if not len(self.count):
            return out
        at = np.searchsorted(self.keys[0], keys[0])
        alive = np.arange(len(out))
        while len(alive):  # of keys with an equal first half the one with the right second half
            alive = alive[at[alive] < len(self.count)]
            alive = alive[self.keys[0][at[alive]] == keys[0][alive]]
            right = np.logical_and.reduce([k[at[alive]] == asked[alive] for k, asked in zip(self.keys, keys, strict=True)])
            out[alive[right]] = self.count[at[alive[right]]]
            alive = alive[~right]
            at[alive] += 1
        return out


def score_documents(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", range_tokens: int = RANGE_TOKENS, chunk_tokens: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row, learned from the rows for which train holds.

    train: a condition on the rows' columns; null counts as false. A null text counts as empty: one token,
    its end. Repeated rows each count and each get a row. With no training text nothing is known and every
    token has probability 1. Empty docs give an empty result. Other columns are ignored. A chunk's texts
    are held in one worker, a text of more than chunk_tokens tokens makes a chunk of its own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            ids, size, train, h, g = (pa.concat_arrays(c) if i == 0 else np.concatenate(c) for i, c in enumerate(zip(*parts, strict=True)))
            learned = int(size[train].sum())
            blob = Chunk.of(size, train, h, g).packed()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(size.sum())]), pa.array([learned]), ids, pa.array([blob], pa.binary())], ["chunk", "n", "learned", "ids", "blob"])

        for batch in steps(batches):
            text, h, g = tokens(batch.column("text"))
            parts.append((batch.column("doc_id"), np.bincount(text, minlength=batch.num_rows), batch.column("train").to_numpy(zero_copy_only=False).astype(bool), h, g))
            held += len(h)
            if held >= chunk_tokens:
                yield chunk()
                number, parts, held = number + 1, [], 0
        if parts:
            yield chunk()

    chunks = materialize(rows.mapInArrow(read, "chunk long, n long, learned long, ids array<long>, blob binary"), "chunks")
    total = chunks.agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"), F.count("*").alias("chunks")).first()
    n_train = total.learned or 0
    n_ranges = max(16, -(-(total.n or 0) // range_tokens))
    n_parts, n_chunk_parts = min(n_ranges, MOST_PARTS), max(1, min(-(-total.chunks // PART_CHUNKS), MOST_PARTS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk and range the n-grams, with how often the chunk's training texts hold them."""
        for batch in batches:
            for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                chunk = Chunk.unpacked(blob.as_py())
                chunk.grams()
                sent = [(r, pack_ints((_gaps(chunk.key[w]), 8), (chunk.check[w], 8), (chunk.word_count[w], 4), (_gaps(chunk.pair_key[p]), 8), (chunk.pair_count[p], 4))) for r, w, p in chunk.ranges(n_ranges)]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in sent], pa.int64()), pa.array([number] * len(sent), pa.int64()), pa.array([b for _, b in sent], pa.binary())], ["r", "chunk", "blob"])

    def opened(blob: bytes) -> list[np.ndarray]:
        h, g, c, pair, d = unpack_ints(blob)
        return [np.cumsum(h, dtype=np.uint64), g, c.astype(np.int64), np.cumsum(pair, dtype=np.uint64), d.astype(np.int64)]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by range: all of a range's n-grams make its block, which then tells each chunk the levels of its own."""
        now, held, words, pairs = None, [], Counts(2), Counts(1)

        def answers() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            words.settle()
            pairs.settle()
            word_level = level_of(words.count)
            keys = np.concatenate([mix(words.keys[0]) >> _KEPT, pairs.keys[0]])
            block = Filter(keys, np.concatenate([word_level, level_of(pairs.count)]))
            probe = Probe(block, keys)
            asked, size = [], 0
            for i, (number, blob) in enumerate(held):
                asked.append((number, opened(blob)))
                held[i] = None
                size += len(asked[-1][1][0]) + len(asked[-1][1][3])
                if size < FLUSH and i + 1 < len(held):
                    continue
                keys = [(mix(h) >> _KEPT, pair) for _, (h, _, _, pair, _) in asked]
                level = probe(np.concatenate([k for both in keys for k in both]))
                cuts = np.cumsum([0, *(len(k) for both in keys for k in both)]).tolist()
                blobs = [pack_ints((words.find(h, g), 8), (level[cuts[2 * j] : cuts[2 * j + 1]], 2), (level[cuts[2 * j + 1] : cuts[2 * j + 2]], 2)) for j, (_, (h, g, _, _, _)) in enumerate(asked)]
                n = len(asked)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in asked], pa.int64()), pa.array([now] * n, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], ["chunk", "r", "blob", "v", "q"])
                asked, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([now]), pa.nulls(1, pa.binary()), pa.array([len(words.count)]), pa.array([float(count_of(word_level).sum())])], ["chunk", "r", "blob", "v", "q"])

        for batch in batches:
            for r, number, blob in zip(batch.column("r").to_pylist(), batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                if r != now:
                    yield from answers()
                    now, held, words, pairs = r, [], Counts(2), Counts(1)
                held.append((number, blob.as_py()))
                h, g, c, pair, d = opened(held[-1][1])
                words.add(h, g, c)
                pairs.add(pair, d)
        yield from answers()

    by_range = chunks.mapInArrow(gives_back(ask), "r long, chunk long, blob binary").repartitionById(n_parts, F.pmod("r", F.lit(n_parts)).cast("int")).sortWithinPartitions("r", "chunk")
    told = materialize(by_range.mapInArrow(gives_back(probed), "chunk long, r long, blob binary, v long, q double"), "answers")
    known = told.where("chunk IS NULL").agg(F.sum("v").alias("v"), F.sum("q").alias("q")).first()
    n_words = known.v or 0
    space, quantised = float(n_train + n_words + 1), (known.q or 0.0) + n_words + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chunk and range, a chunk's tokens last."""
        got = []
        for batch in batches:
            for number, r, blob, ids in zip(batch.column("chunk").to_pylist(), batch.column("r").to_pylist(), batch.column("blob"), batch.column("ids"), strict=True):
                if r < n_ranges:
                    got.append((r, unpack_ints(blob.as_py())))
                    continue
                chunk = Chunk.unpacked(blob.as_py())
                chunk.grams()
                exact, word, pair = np.zeros(len(chunk.key), np.int64), np.zeros(len(chunk.key), np.int64), np.zeros(len(chunk.pair_key), np.int64)
                asked = list(chunk.ranges(n_ranges))
                if [r for r, _ in got] != [r for r, _, _ in asked]:
                    raise RuntimeError(f"chunk {number}: answers of {len(got)} ranges of {len(asked)}")
                for (_, w, p), (_, (c, a, b)) in zip(asked, got, strict=True):
                    exact[w], word[w], pair[p] = c, a, b
                got = []
                n, back, before = len(chunk.size), chunk.back, chunk.before
                text = np.repeat(np.arange(n), chunk.size)
                single = count_of(word)
                both = count_of(np.minimum(pair[chunk.pair], np.minimum(word[back], word[before])))
                p = (both + PRIOR * ((single + 1) / quantised)[back]) / (single[before] + PRIOR)
                total = np.bincount(text, weights=np.log10(np.minimum(p, 1.0)), minlength=n)
                base = np.bincount(text, weights=np.log10((exact + 1) / space)[back], minlength=n)
                known = np.bincount(text, weights=(exact > 0)[back], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(chunk.size), pa.array(known), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(total)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = chunks.select("chunk", F.lit(n_ranges).cast("long").alias("r"), "blob", "ids")
    answered = told.where("chunk IS NOT NULL").select("chunk", "r", "blob", F.lit(None).cast("array<long>").alias("ids"))
    by_chunk = answered.unionByName(own).repartitionById(n_chunk_parts, F.pmod(F.xxhash64("chunk"), F.lit(n_chunk_parts)).cast("int")).sortWithinPartitions("chunk", "r")
    return by_chunk.mapInArrow(gives_back(score), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
