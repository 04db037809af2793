"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

A byte-pair encoding is the one token sequence in which every two neighbours are what the merges make
of their joined bytes. So, reading a pre-token byte by byte, the last token of each prefix is decided
by the last tokens of the shorter prefixes that a vocabulary entry can still start from. A state is
that list: for each open start, its place in the vocabulary's trie, the last token before it, and how
many fewer tokens it has. States are made when first reached and interned, so the machine is
deterministic; a transition carries the number of tokens by which the count changes.

A long text is read in chunks that start anywhere, inside a pre-token, too. A chunk's state map tells
for every state that the machine may come in with the state it goes out with and how the count
changes. Where a pre-token begins the machine is back at its start, so what comes after a chunk's
first such place is the same for every state: pre-tokens that lie in the chunk as a whole are counted
by the memory of pre-tokens, the open one at its end is read from the start. What comes before that
place is read once from the start as the reference; from another state it is read only until the
state is the reference's, from where on the reference tells the rest. Maps compose associatively and
are combined in a tree, as in a parallel prefix scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Known, byte_level
from .vectext import PreTokens, kept, steps

#: Bytes of a chunk.
CHUNK = 1 << 14
#: Distinct pre-tokens whose counts a worker keeps, states of the machine (about 1 KB each) and token pairs tried; beyond it they start afresh.
MEMORY, STATES, PAIRS = 1_500_000, 400_000, 1_000_000


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Transducer:
    START = 0

    def __init__(self, path: str) -> None:
        spec, symbol = byte_level(path), byte_symbols()
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {bytes(symbol[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in set(self.added)}
        self.bytes_of = {i: b for b, i in self.tokens.items()}
        # A token's age is the number of the merge that makes it; single bytes have none and are never undone.
        self.age, self.half = dict.fromkeys(self.bytes_of, -1), {}
        self.join: dict[tuple[int, int], tuple[int, int]] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = (self.tokens[bytes(symbol[c] for c in x)] for x in (m if isinstance(m, list) else m.split(" ")))
            made = self.tokens[self.bytes_of[a] + self.bytes_of[b]]
            self.join[a, b] = (n, made)
            if made not in self.half:
                self.age[made], self.half[made] = n, (a, b)
        self.child: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for text, i in self.tokens.items():
            node = 0
            for b in text:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = self.child[node][b]
            self.ends[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the merges turn the two tokens' joined bytes into just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        """Undo the merges beside the seam, latest first; a merge across it that would have come earlier breaks it.

        Of equal merges the one further left comes first, so one across the seam loses to the same merge
        inside the left token and wins against it inside the right token.
        """
        limit = 2 * len(self.join) + 2  # twice the merge number, and one more for the right side
        while True:
            across = self.join.get((left, right))
            if across is not None and 2 * across[0] < limit:
                return False
            a, b = self.age[left], self.age[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = 2 * a, self.half[left][1]
            else:
                limit, right = 2 * b + 1, self.half[right][0]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from state on byte, made and kept."""
        opened, last, change = [], -1, 0
        for node, before, fewer in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            token = self.ends[to]
            if last < 0 and token >= 0 and (before < 0 or self.neighbours(before, token)):
                last, change = token, 1 - fewer
            if self.child[to]:
                opened.append((to, before, fewer))
        new = (*((node, before, fewer + change) for node, before, fewer in opened), (0, last, 0))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        move = self.moves[state][byte] = (self.number[new], change)
        return move

    def run(self, state: int, text: bytes) -> tuple[int, int]:
        """The state after text, and the change of the count."""
        total, moves = 0, self.moves
        for byte in text:
            move = moves[state].get(byte) or self.compile(state, byte)
            state = move[0]
            total += move[1]
        return state, total

    def count_pretoken(self, text: bytes) -> int:
        return self.run(self.START, text)[1]


class StateMap:
    """What a chunk does to a state: `head` is its part before the first pre-token that begins in it, `rest` what comes after from there (state, count)."""

    def __init__(self, machine: Transducer, head: bytes, rest: tuple[int, int] | None) -> None:
        self.machine, self.head, self.rest, self.table = machine, head, rest, {}
        # the reference: states and counts after every byte of the head, read from the start
        self.states, self.counts, state, total = [Transducer.START], [0], Transducer.START, 0
        for byte in head:
            state, change = machine.moves[state].get(byte) or machine.compile(state, byte)
            total += change
            self.states.append(state)
            self.counts.append(total)

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.table:
            out, total, moves = state, 0, self.machine.moves
            for i, byte in enumerate(self.head):
                if out == self.states[i]:  # from here on as the reference
                    out, total = self.states[-1], total + self.counts[-1] - self.counts[i]
                    break
                out, change = moves[out].get(byte) or self.machine.compile(out, byte)
                total += change
            self.table[state] = (out, total) if self.rest is None else (self.rest[0], total + self.rest[1])
        return self.table[state]


class Composed:
    """The state map of two pieces of text that follow each other."""

    def __init__(self, left: StateMap | Composed, right: StateMap | Composed) -> None:
        self.left, self.right, self.table = left, right, {}

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.table:
            between, first = self.left(state)
            out, second = self.right(between)
            self.table[state] = (out, first + second)
        return self.table[state]


def reduced(maps: list) -> StateMap | Composed:
    """All maps composed, neighbours first: the last step of a parallel prefix scan."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Counter:
    def __init__(self, path: str) -> None:
        self.machine = Transducer(path)
        self.known = Known(np.uint32, MEMORY, lambda words: [(self.machine.count_pretoken(w),) for w in words])
        self.special = re.compile("|".join(map(re.escape, self.machine.added))) if self.machine.added else None

    def _bound(self) -> None:
        """Start the machine's memories afresh when they are full; no state map may be in use."""
        if len(self.machine.states) > STATES:
            self.machine.reset()
        if len(self.machine.pairs) > PAIRS:
            self.machine.pairs.clear()

    def each(self, pre: PreTokens) -> np.ndarray:
        """The count of every pre-token."""
        place, odd = self.known.look_up(pre)
        memo = self.known.memo
        out = memo.flat[memo.at[place]].astype(np.int64) if len(memo.at) else np.zeros(len(place), np.int64)
        if odd.any():  # they share a hash with others
            out[odd] = [self.machine.count_pretoken(w) for w in pre.words(np.flatnonzero(odd))]
        return out

    def plain(self, texts: list[str]) -> np.ndarray:
        """Counts of texts without added strings, pre-token by pre-token."""
        self._bound()
        pre = PreTokens(texts)
        return np.bincount(pre.text, weights=self.each(pre), minlength=len(texts)).astype(np.int64)

    def maps(self, text: str, chunk: int) -> list[StateMap]:
        """The state maps of the text's chunks of so many bytes."""
        self._bound()
        pre = PreTokens([text])
        first, data, out = pre.first, pre.bytes, []
        whole = first // chunk == (pre.last - 1) // chunk  # the others are read by the machine, piece by piece
        count = np.zeros(len(first), np.int64)
        count[whole] = self.each(pre.take(np.flatnonzero(whole)))
        upto = np.concatenate([[0], np.cumsum(count)])
        for a in range(0, len(data), chunk):
            b = min(a + chunk, len(data))
            low, high = np.searchsorted(first, [a, b]).tolist()  # the pre-tokens that begin here
            if low == high:
                out.append(StateMap(self.machine, data[a:b], None))
                continue
            state, tail = (Transducer.START, 0) if whole[high - 1] else self.machine.run(Transducer.START, data[int(first[high - 1]) : b])
            out.append(StateMap(self.machine, data[a : int(first[low])], (state, int(upto[high] - upto[low]) + tail)))
        return out

    def scan(self, text: str, chunk: int = CHUNK) -> int:
        """The count of one text from its chunks' maps."""
        return reduced(self.maps(text, chunk))(Transducer.START)[1] if text else 0

    def count(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                if len(part) > chunk:
                    out[i] += self.scan(part, chunk)
                else:
                    pieces.append(part)
                    owner.append(i)
        np.add.at(out, np.array(owner, np.int64), self.plain(pieces))
        return out


def counter(path: str) -> Counter:
    return kept(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; one row for each row, null counting as empty.

    No shuffle and no state outside a worker; repeated rows and ids give repeated results.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, keeps=True):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            count = counter(tokenizer).count(texts, chunk)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(count), pa.array(count > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
