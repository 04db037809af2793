"""N-gram Jaccard join: exact links between documents whose shingle sets are similar, by T-occurrence search.

1. Equal sets make a class (128-bit digest); one document stands for it.
2. Blocking, exact: sets that link differ in at most H shingles, H following from their sizes. Shingles
   are dealt to numbered parts by hash, so at most H parts differ. A set signs its first H + 1 non-empty
   parts; two linked sets share a signature. Very frequent shingles (told by a bounded sample, which
   changes the speed and nothing else) are left out, as that only shrinks the difference; a set that
   then has too few parts signs all its parts as they are with all shingles, too. Of the sets with a
   common signature, those go to one cluster that a bitmap of their shingles' parities lets pass: it
   differs in at most as many bits as the sets do in shingles.
   One row of each class signs. Sets that share many signatures are one group, and held against each other once.
   Signatures that very many sets share are cut into blocks of sets, and pairs of blocks go to tasks of their own.
3. T-occurrence search within a cluster: an inverted index of its sets; for a query set, the short lists
   are merged by a heap, which counts each set's occurrences, the long ones are probed by binary search
   for what is still within reach (DivideSkip), and sets that reach the required overlap are linked.
   No link comes about in another way. Clusters beyond a bound are cut into blocks that are searched apart;
   documents that don't link to the cluster's pivot are searched in those other blocks that hold a set
   whose bitmap lets them pass.
Only links that can join two components are looked for: a set already linked to the pivot's component
needs no search of its own. Copies and near copies therefore cost a row each, not a pair each.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize
from .vectext import Words, mix, shingles, steps

#: Documents of the sample, and how many of them make a shingle or a signature frequent.
SAMPLE, HOT = 4096, 8
#: Shingles and sets in one block of a cluster, sets of one signature in a block, bits of a set's parities, and bits of the bitmap of cluster members (8 MB).
BLOCK, BLOCK_SETS, GROUP, SKETCH, BITMAP = 1 << 18, 192, 8192, 1 << 16, 1 << 26
#: Documents that are searched in another block by one task.
TURN = 256
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Rule:
    """Sets of sizes a and b link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least intersection that links sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.num // self.den)

    @lru_cache(4)  # noqa: B019  one rule a process
    def classes(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size classes up to top: first size, H of a set in it and one not smaller that it can link with, parts."""
        low, width = [1], 1.25 if self.num / self.den > 0.85 else 2.0
        while low[-1] <= top:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * width)))
        first = np.array(low, np.int64)
        last = np.concatenate([first[1:] - 1, first[-1:]])
        differ = (last + last * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        parts = []
        for n, h in zip(first.tolist(), differ.tolist(), strict=True):
            p = h + 1
            while p < 8 * n:  # so many parts that h + 1 of a set's are hardly ever empty
                empty = math.exp(-n / p)
                if p * (1 - empty) - 4 * math.sqrt(p * empty * (1 - empty)) >= h + 1:
                    break
                p += max(1, p // 16)
            parts.append(p)
        return first, differ, np.array(parts, np.int64)


def signatures(text: np.ndarray, value: np.ndarray, n_texts: int, rule: Rule, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of sets given as sorted distinct (text, shingle); hot: sorted frequent shingles."""
    size = np.bincount(text, minlength=n_texts)
    top = int(size.max(initial=0))
    if not top:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, differ, parts = rule.classes(1 << top.bit_length())
    own = np.searchsorted(first, np.maximum(size, 1), side="right") - 1
    cold = np.ones(len(value), bool)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
        cold = hot[place] != value
    out = []
    for step in (0, 1):  # a set's own class, and the one below where that holds sizes that it can link with
        level = own - step
        active = (size > 0) & (level >= 0)
        active[active] &= differ[level[active]] > 0
        if step:
            active[active] &= rule.least(size[active]) < first[own[active]]
        some, few = _sign(text, value, active, level, parts, differ, cold, np.uint64(1))
        out.append(some)
        again = np.zeros(n_texts, bool)
        again[few] = True
        if again.any():
            some, few = _sign(text, value, again, level, parts, differ, np.ones(len(value), bool), np.uint64(2))
            out += [some, (few, mix(level[few].astype(np.uint64) * _SALT + np.uint64(3)))]  # a mark for sets with too few parts
    return np.concatenate([t for t, _ in out]), np.concatenate([s for _, s in out])


def _sign(text, value, active, level, parts, differ, use, kind) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The first H + 1 non-empty parts' signatures, and the sets that have fewer."""
    rows = active[text] & use
    owner, v = text[rows], value[rows]
    lv = level[owner].astype(np.uint64)
    part = (mix(v ^ (lv * _SALT)) % parts[level[owner]].astype(np.uint64)).astype(np.int64)
    slots = np.where(active, parts[np.maximum(level, 0)], 0)
    base = np.cumsum(slots) - slots
    total = int(slots.sum())
    held, filled = np.zeros(total, np.uint64), np.zeros(total, bool)
    at = base[owner] + part
    np.add.at(held, at, mix(v + _SALT))
    filled[at] = True
    where = np.flatnonzero(filled)
    whose = np.repeat(np.arange(len(slots)), slots)[where]
    count = np.bincount(whose, minlength=len(slots))
    rank = np.arange(len(where)) - (np.cumsum(count) - count)[whose]
    need = np.where(active, differ[np.maximum(level, 0)] + 1, 0)
    keep = rank < need[whose]
    where, whose = where[keep], whose[keep]
    number = (where - base[whose]).astype(np.uint64)
    sig = mix(held[where] + number * _M + level[whose].astype(np.uint64) * _SALT + kind)
    return (whose, sig), np.flatnonzero(active & (count < need))


_M = np.uint64(0xA0761D6478BD642F)


class Index:
    """Inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray], rule: Rule) -> None:
        self.rule, self.sizes = rule, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.lists = flat[order], owner[order]  # a list's members rise
        edge = np.ones(len(flat), bool)
        edge[1:] = flat[1:] != flat[:-1]
        self.keys = flat[edge]
        self.begin = np.concatenate([np.flatnonzero(edge), [len(flat)]])

    def search(self, query: np.ndarray) -> np.ndarray:
        """Members of the block that link with the query set."""
        size = len(query)
        if not size or not len(self.keys):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        place = place[self.keys[place] == query]
        fits = (self.sizes >= self.rule.least(size)) & (self.rule.least(self.sizes) <= size) & (self.sizes > 0)
        if not fits.any():
            return np.zeros(0, np.int64)
        need = int(self.rule.overlap(size, self.sizes[fits].min()))
        if len(place) < need:
            return np.zeros(0, np.int64)
        length = self.begin[place + 1] - self.begin[place]
        order = np.argsort(length, kind="stable")
        place, length = place[order], length[order]
        n_long = min(need - 1, int(need / (0.01 * math.log2(int(length[-1]) + 1) + 1)))
        n_long = min(n_long, int((length > 4).sum()))  # probing pays for long lists only
        short, long = place[: len(place) - n_long], place[len(place) - n_long :]
        merged = heapq.merge(*(self.lists[self.begin[p] : self.begin[p + 1]].tolist() for p in short.tolist()))
        counted = [(x, n) for x, run in itertools.groupby(merged) if (n := sum(1 for _ in run)) >= need - n_long and fits[x]]
        if not counted:
            return np.zeros(0, np.int64)
        alive, count = np.array(counted, np.int64).T
        required = self.rule.overlap(size, self.sizes[alive])
        for i, p in enumerate(long[::-1] if n_long else ()):
            members = self.lists[self.begin[p] : self.begin[p + 1]]
            at = np.minimum(np.searchsorted(members, alive), len(members) - 1)
            count = count + (members[at] == alive)
            keep = count + (n_long - 1 - i) >= required
            alive, count, required = alive[keep], count[keep], required[keep]
            if not len(alive):
                break
        return alive[count >= required]


def block_labels(ids: list[int], sets: list[np.ndarray], rule: Rule) -> list[int]:
    """For each set the smallest id of its component within the block; ids rise."""
    index, parent = Index(sets, rule), list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q in range(len(ids)):
        if q and root(q) == root(0):
            continue
        for hit in index.search(sets[q]).tolist():
            a, b = root(q), root(hit)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [ids[root(i)] for i in range(len(ids))]


def sketch(members: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, odd or even; as many bits as shingles, a power of two from 64 to SKETCH."""
    bits = min(1 << max(6, int(len(members) - 1).bit_length()), SKETCH)
    return np.packbits(np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _aligned(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of words, folded to the shortest one's length."""
    least = min(map(len, sketches))
    out = []
    for s in sketches:
        row = np.frombuffer(s, np.uint64)
        while len(row) * 8 > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out.append(row)
    return np.stack(out)


def near(rule: Rule, size: int, bits: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of the rows may link with a set of this size and sketch: sizes fit and few enough bits differ."""
    differ = np.bitwise_count(table ^ bits).sum(1)
    return (sizes >= rule.least(size)) & (rule.least(sizes) <= size) & (differ * (rule.num + rule.den) <= (sizes + size) * (rule.den - rule.num))


def likely_edges(nodes: np.ndarray, sizes: np.ndarray, table: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link: every one that is reached is held against all that are not."""
    edges, left = [], np.arange(len(nodes))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            q = front.pop()
            hit = near(rule, int(sizes[q]), table[q], sizes[left], table[left])
            edges += [(int(nodes[q]), int(nodes[x])) for x in left[hit]]
            front += left[hit].tolist()
            left = left[~hit]
    return edges


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    text, value = shingles(Words(batch.column("text")), size, batch.num_rows)
    return np.split(value, np.searchsorted(text, np.arange(1, batch.num_rows)))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[tuple[tuple, list]]:
    """Runs of rows with equal keys, as (key, [(row, set)]); rows hold all columns but text."""
    now, held = None, []
    for batch in steps(batches):
        rows = batch.drop_columns(["text"]).to_pylist()
        for row, members in zip(rows, _sets(batch, size), strict=True):
            key = tuple(row[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append((row, members))
    if held:
        yield now, held


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys."""
    rows = itertools.chain.from_iterable(batch.to_pylist() for batch in batches)
    for key, run in itertools.groupby(rows, lambda r: tuple(r[k] for k in keys)):
        yield key, list(run)


def jaccard_components(docs: DataFrame, *, size: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, block: int = BLOCK, block_sets: int = BLOCK_SETS, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included).

    A set holds the distinct runs of size words (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+); with fewer
    words, the whole sequence as one. A null or blank text has an empty set and links with nothing. Rows
    with a null id are left out; repeated ids give repeated rows, and an id carries the links of all its texts. An empty table gives an
    empty result. Shingles are compared by 64-bit hash. Components only are returned: links that would not
    join two components are not looked for. Other columns are ignored.
    """
    spark, rule = docs.sparkSession, Rule(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = _sets(batch, size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            node = pa.array([int.from_bytes(k[:8], "little", signed=True) if k else None for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), node, pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "key", "node", "sketch"])

    each = materialize(rows.mapInArrow(digest, "doc_id long, n_shingles long, key binary, node long, sketch binary"), "shingle-sets")
    first = (F.first(c).alias(to) for c, to in (("node", "node"), ("n_shingles", "n"), ("sketch", "sketch")))
    classes = materialize(each.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), *first), "classes")
    each = each.drop("sketch")

    # What is frequent, told by a sample of bounded size (below twice `sample` ids, so they can be broadcast): only the speed depends on it.
    n_classes = classes.count()
    rate = max(1, n_classes // sample)
    chosen = classes.where(F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(rate)) == 0).select(F.col("rep").alias("doc_id"))
    picked = materialize(rows.join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sample") if n_classes else rows.limit(0)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for s in _sets(batch, size):
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64))], ["h"])

    counted = picked.mapInArrow(sampled, "h long").groupBy("h").count().where(F.col("count") >= HOT).select("h")
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in counted.collect()], np.int64).astype(np.uint64)))

    def signed(batches: Iterator[pa.RecordBatch], pivots=None, reps=None) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in steps(batches if reps is None else _maybe(batches, reps.value)):
            text, value = shingles(Words(batch.column("text")), size, batch.num_rows)
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1))
            node = np.zeros(batch.num_rows, np.int64)
            fresh = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                s = value[edges[i] : edges[i + 1]]
                if len(s):
                    node[i] = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True)
                    fresh[i] = node[i] not in seen
                    seen.add(int(node[i]))
            keep = fresh[text]
            owner, sig = signatures(text[keep], value[keep], batch.num_rows, rule, hot.value)
            sig, owner, pivot = sig.astype(np.int64), node[owner], np.zeros(len(sig), np.int64)
            known = np.zeros(len(sig), bool)
            if pivots is not None and len(pivots.value[0]):
                names, to = pivots.value
                place = np.minimum(np.searchsorted(names, sig), len(names) - 1)
                known = names[place] == sig
                pivot[known] = to[place[known]]
                # Within a batch one row for each pair of nodes says it all.
                pairs = np.unique(np.stack([pivot[known], owner[known]], 1), axis=0) if known.any() else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), None), pa.int64()), pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["sig", "node", "pivot"])
            rest = ~known
            yield pa.RecordBatch.from_arrays([pa.array(sig[rest]), pa.array(owner[rest]), pa.array(np.full(int(rest.sum()), None), pa.int64())], ["sig", "node", "pivot"])

    out = "sig long, node long, pivot long"
    known_sets = classes.select("node", "n", "sketch").dropDuplicates(["node"])
    common = picked.mapInArrow(signed, out).groupBy("sig").agg(F.array_sort(F.collect_list("node")).alias("nodes")).where(F.size("nodes") >= HOT).orderBy("sig").collect()
    # A frequent signature whose sets are near copies of the first ties all its sets to that one, right where they are signed.
    about = {r.node: (r.n, bytes(r.sketch)) for r in classes.join(F.broadcast(chosen.withColumnRenamed("doc_id", "rep")), "rep").select("node", "n", "sketch").collect()} if common else {}
    tied = []
    for r in common:
        held = [(n, *about[n]) for n in r.nodes if n in about]
        table, sizes = _aligned([x for _, _, x in held]), np.array([n for _, n, _ in held], np.int64)
        if near(rule, int(sizes[0]), table[0], sizes, table).mean() >= 0.9:
            tied.append((r.sig, held[0][0]))
    pivots = spark.sparkContext.broadcast((np.array([x for x, _ in tied], np.int64), np.array([x for _, x in tied], np.int64)))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by signature and node: the nodes of each signature that two or more share, those of more than group
        nodes as a row each. Rows with a pivot pass as they are."""
        held = np.zeros((2, 0), np.int64)  # signature and node of the last rows, whose signature may go on
        given = False  # whether they are part of a large group, given out but for those after the first one held

        def rows_of(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.nulls(len(sig), pa.int64()), pa.nulls(len(sig), nodes)], names)

        def grouped(sig: np.ndarray, node: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
            count = np.diff(start, append=len(sig))
            many = np.repeat(count > group, count)
            if many.any():
                yield rows_of(sig[many], node[many])
            few = (count > 1) & (count <= group)
            if few.any():
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[few])]), pa.int32()), pa.array(node[np.repeat(few, count)]))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(lists), pa.int64()) for _ in range(3)), lists], names)

        for batch in batches:
            here = batch.column("pivot").is_valid().to_numpy(zero_copy_only=False)
            if here.any():
                tied = batch.filter(pa.array(here))
                yield pa.RecordBatch.from_arrays([*tied.columns, pa.nulls(tied.num_rows, nodes)], names)
            both = np.stack([batch.column(c).filter(pa.array(~here)).to_numpy().astype(np.int64) for c in ("sig", "node")])
            both = np.concatenate([held, both], axis=1)
            if not both.shape[1]:
                continue
            new = np.ones(both.shape[1], bool)  # copies sign alike: a node counts once
            new[1:] = (both[:, 1:] != both[:, :-1]).any(0)
            sig, node = both[:, new]
            start = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
            if given:
                end = int(start[1]) if len(start) > 1 else len(sig)
                yield rows_of(sig[1:end], node[1:end])
                if len(start) == 1:
                    held = np.stack([sig[-1:], node[-1:]])
                    continue
                sig, node, start = sig[end:], node[end:], start[1:] - end
            last = int(start[-1])
            yield from grouped(sig[:last], node[:last], start[:-1])
            held, given = np.stack([sig[last:], node[last:]]), len(sig) - last > group
            if given:
                yield rows_of(*held)
                held = held[:, -1:]
        if held.shape[1] and not given:
            yield from grouped(*held, np.zeros(1, np.int64))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by signature and pair of blocks, with size and sketch."""
        now, held = None, []

        def done() -> pa.RecordBatch:
            nodes = np.array([n for n, _, _ in held], np.int64)
            found = likely_edges(nodes, np.array([n for _, n, _ in held], np.int64), _aligned([s for _, _, s in held]), rule)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for sig, part, *row in zip(*(batch.column(c).to_pylist() for c in ("sig", "part", "node", "n", "sketch")), strict=True):
                if (sig, part) != now:
                    if len(held) > 1:
                        yield done()
                    now, held = (sig, part), []
                held.append(row)
        if len(held) > 1:
            yield done()

    # One row of each class signs, and sets that share many signatures are held against each other once: their group is a row.
    names, nodes = ["sig", "node", "pivot", "nodes"], pa.list_(pa.int64())
    reps = _bitmap(classes.select("rep"))
    every = _placed(rows).mapInArrow(lambda it: signed(it, pivots, reps), out)
    dealt = every.repartition(F.coalesce("sig", F.xxhash64("node", "pivot"))).sortWithinPartitions("sig", "node")
    shared = materialize(dealt.mapInArrow(runs, out + ", nodes array<long>").distinct(), "shared-signatures")
    shared_sigs = shared.where("sig IS NOT NULL").select("sig", "node")
    large = shared_sigs.groupBy("sig").count().where(F.col("count") > group).select("sig", F.ceil(F.col("count") / group).cast("int").alias("blocks"))
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = lambda x: F.least(x, place) * F.col("blocks") + F.greatest(x, place)
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))
    dealt = shared_sigs.join(large, "sig", "left").select("sig", "node", F.explode(parts).alias("part"))
    dealt = dealt.unionByName(shared.where("nodes IS NOT NULL").select(F.xxhash64("nodes").alias("sig"), F.explode("nodes").alias("node"), F.lit(0).alias("part")))
    groups = dealt.join(known_sets, "node").select("sig", "part", "node", "n", "sketch")
    found = groups.repartition("sig", "part").sortWithinPartitions("sig", "part", "node").mapInArrow(edges, "a long, b long")
    clusters = connected_components(found.unionByName(shared.where("pivot IS NOT NULL").select(F.col("pivot").alias("a"), F.col("node").alias("b"))))

    members = classes.drop("sketch").join(clusters.withColumnRenamed("label", "cluster"), "node").select("cluster", F.col("rep").alias("doc_id"), "n")
    members = materialize(members, "members")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("n"), F.min("doc_id").alias("pivot"), F.count("*").alias("sets")).withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("sets") / block_sets)).cast("int"))
    placed = members.drop("n").join(sizes.drop("n", "sets"), "cluster")
    spread = F.when((F.col("doc_id") == F.col("pivot")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    placed = placed.withColumn("block", F.explode(spread))
    source = _likely(rows, members).join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    keyed = materialize(source.dropDuplicates(["doc_id", "text"]), "member-texts")
    work = placed.join(keyed, "doc_id").repartition("cluster", "block").sortWithinPartitions("cluster", "block", "doc_id")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cluster, number), held in _groups(batches, ["cluster", "block"], size):
            ids = [r["doc_id"] for r, _ in held]
            labels = block_labels(ids, [s for _, s in held], rule)
            yield pa.RecordBatch.from_arrays([pa.array([cluster] * len(ids), pa.int64()), pa.array([number] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array([r["pivot"] for r, _ in held], pa.int64()), pa.array([r["blocks"] for r, _ in held], pa.int32())], ["cluster", "block", "doc_id", "label", "pivot", "blocks"])

    found = materialize(work.mapInArrow(label, "cluster long, block int, doc_id long, label long, pivot long, blocks int"), "labels")
    alone = found.where((F.col("blocks") > 1) & (F.col("label") != F.col("pivot")))
    labels = found.select("doc_id", "label")
    n_alone = alone.count()
    if n_alone:
        labels = _across(found, alone, keyed, classes.select(F.col("rep").alias("doc_id"), "n", "sketch"), rule, size)
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("component_id"))
    by_class = classes.drop("sketch").join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    return each.join(by_class, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id_col, not null, isn't among ids (one column of that name, not null).

    A bitmap of fixed size (8 MB) tells the rows whose id may be there, and only these are shuffled for the exact join.
    """
    place = F.pmod(F.xxhash64(id_col), F.lit(BITMAP)) + 1
    bitmap = ids.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)}).join(F.broadcast(bitmap), "_bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.expr("shiftright(_byte, CAST(_bit & 7 AS INT)) & 1") == 1, F.lit(False))
    marked = marked.withColumn("_byte", byte).withColumn("_maybe", maybe)
    rest = marked.where("_maybe").select(rows.columns).join(ids, id_col, "left_anti")
    return marked.where("NOT _maybe").select(rows.columns).unionByName(rest.select(rows.columns))


def _likely(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows whose id may be a member's, told by a bitmap of fixed size: other texts need not be shuffled.

    Where members are so many that the bitmap fills up, more rows pass, and the join after it decides all the same.
    """
    sent = _bitmap(members.select("doc_id"))
    return _placed(rows).mapInArrow(lambda it: _maybe(it, sent.value), "doc_id long, text string")


def _places(id_col: str) -> tuple[Column, Column]:
    """Bucket and bit of an id in a bitmap."""
    place = F.pmod(F.xxhash64(id_col), F.lit(BITMAP)) + 1
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place)


def _placed(rows: DataFrame) -> DataFrame:
    """rows with their ids' buckets and bits as b and p, for _maybe."""
    b, p = _places("doc_id")
    return rows.withColumns({"b": b, "p": p})


def _bitmap(ids: DataFrame) -> Broadcast:
    """The buckets of a bitmap (8 MB at most) of a column of ids, sent to the workers."""
    b, p = _places(ids.columns[0])
    bitmap = ids.select(b.alias("b"), p.alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).toArrow()
    held = {int(b): np.frombuffer(bits.as_buffer(), np.uint8) for b, bits in zip(bitmap["b"].to_pylist(), bitmap["bits"], strict=True)}
    return ids.sparkSession.sparkContext.broadcast(held)


def _maybe(batches: Iterator[pa.RecordBatch], held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """doc_id and text of the rows whose bit is set."""
    for batch in batches:
        bucket, bit = batch.column("b").to_numpy(), batch.column("p").to_numpy()
        there = np.zeros(batch.num_rows, bool)
        for b in np.unique(bucket).tolist():
            if b in held:
                some = bucket == b
                there[some] = held[b][bit[some] >> 3] >> (bit[some] & 7) & 1 == 1
        if there.any():
            yield batch.filter(pa.array(there)).select(["doc_id", "text"])


def _across(found: DataFrame, alone: DataFrame, texts: DataFrame, sketches: DataFrame, rule: Rule, size: int) -> DataFrame:
    """Labels of all blocks' members once the documents outside the pivots' components were searched in the other blocks."""
    queries = alone.groupBy("cluster").agg(F.count("*").alias("q")).withColumn("turns", F.ceil(F.col("q") / TURN).cast("int")).drop("q")
    data = found.join(queries, "cluster").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("role", F.lit(0))
    asked = alone.withColumnRenamed("block", "own").join(queries, "cluster").withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.col("turns")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> own").withColumn("role", F.lit(1))
    columns, keys = ["cluster", "block", "turn", "role", "doc_id", "label"], ["cluster", "block", "turn"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, "role", "doc_id")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By size and sketch: the asked documents that some set of the block may link with, and the sets that some may."""
        for _, held in _runs(batches, keys):
            data, some = [r for r in held if r["role"] == 0], [r for r in held if r["role"] == 1]
            if not data or not some:
                continue
            table = _aligned([r["sketch"] for r in held])
            sizes, labels = np.array([r["n"] for r in data], np.int64), np.array([r["label"] for r in data], np.int64)
            needed, out = np.zeros(len(data), bool), []
            for i, r in enumerate(some, len(data)):
                hit = near(rule, r["n"], table[i], sizes, table[: len(data)]) & (labels != r["label"])
                if hit.any():
                    needed |= hit
                    out.append(r)
            out = [data[i] for i in np.flatnonzero(needed)] + out
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int32() if c in ("block", "turn", "role") else pa.int64()) for c in columns], columns)

    rows = data.select(columns).unionByName(asked.select(columns))
    kept = materialize(dealt(rows.join(sketches, "doc_id")).mapInArrow(passed, "cluster long, block int, turn int, role int, doc_id long, label long"), "across")
    work = dealt(kept.join(texts, "doc_id"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _groups(batches, keys, size):
            data = [(r["label"], s) for r, s in held if r["role"] == 0]
            index, labels = Index([s for _, s in data], rule), np.array([x for x, _ in data], np.int64)
            pairs = {(r["label"], int(x)) for r, s in held if r["role"] == 1 for x in np.unique(labels[index.search(s)])}
            pairs = [p for p in pairs if p[0] != p[1]]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])

    joined = connected_components(work.mapInArrow(link, "a long, b long"))
    return found.join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("doc_id", F.coalesce("least", "label").alias("label"))
