"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

Pre-tokens are encoded independently of each other, so each distinct one goes to the library once and
its ids are kept in the worker process, by 128 bits of hash; texts are then put together by array
lookups. A text that holds one of the vocabulary's added strings, or a pre-token that shares the first
64 bits with another one, goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from .vectext import PreTokens, kept

#: Distinct pre-tokens kept in a worker process; beyond it those that came once only are dropped.
MEMORY = 800_000


def byte_level(path: str) -> dict:
    """The specification in a tokenizers file, which must be what PreTokens splits and plain merges encode; refused otherwise."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if spec.get("normalizer") or not plain or model.get("type", "BPE") != "BPE" or odd:
        raise ValueError(f"{path}: only byte-level BPE without normalizer, prefix space or word-end marks is read")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take in their surroundings are not read")
    return spec


class Memo:
    """Rows of integers by 128-bit key: sorted first halves, the second ones, and where in `flat` each one's row lies."""

    def __init__(self, dtype: type = np.uint16) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.dtype)
        self.again = np.zeros(0, bool)

    def forget(self) -> None:
        """Drop the rows that weren't looked up again since they were added, or all where that drops too few."""
        keep = np.flatnonzero(self.again)
        if 2 * len(keep) > len(self.key):
            return self.clear()
        size = self.size[keep].astype(np.int64)
        at = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.at[keep] - at, size) + np.arange(int(size.sum()))]
        self.key, self.check, self.at, self.size, self.again = self.key[keep], self.check[keep], at, self.size[keep], np.zeros(len(keep), bool)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the keys, which of them are there, and which are taken by another key of equal first half."""
        place = np.searchsorted(self.key, key)
        there, taken = np.zeros(len(key), bool), np.zeros(len(key), bool)
        inside = np.flatnonzero(place < len(self.key))
        inside = inside[self.key[place[inside]] == key[inside]]
        same = self.check[place[inside]] == check[inside]
        there[inside[same]], taken[inside[~same]] = True, True
        return place, there, taken

    def add(self, key: np.ndarray, check: np.ndarray, rows: list) -> None:
        """New keys in rising order, each with its row."""
        size = np.fromiter(map(len, rows), np.int32, len(rows))
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[:-1] + len(self.flat)
        place = np.searchsorted(self.key, key)
        self.key, self.check = np.insert(self.key, place, key), np.insert(self.check, place, check)
        self.at, self.size, self.again = np.insert(self.at, place, at), np.insert(self.size, place, size), np.insert(self.again, place, False)
        self.flat = np.concatenate([self.flat, np.fromiter((x for row in rows for x in row), self.dtype, int(size.sum()))])


class Known:
    """A memory of what each pre-token comes to, and the lookups of all pre-tokens of some texts."""

    def __init__(self, dtype: type, most: int, make: Callable[[list[bytes]], list]) -> None:
        self.memo, self.most, self.make = Memo(dtype), most, make

    def look_up(self, pre: PreTokens) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token its place in the memory, and whether it can't have one as another one holds its first hash."""
        key, first, back = np.unique(pre.hash, return_index=True, return_inverse=True)
        check = pre.check[first]
        if len(self.memo.key) > self.most:
            self.memo.forget()
        place, there, taken = self.memo.find(key, check)
        self.memo.again[place[there]] = True
        new = ~there & ~taken
        if new.any():
            self.memo.add(key[new], check[new], self.make(pre.words(first[new])))
        place, there, _ = self.memo.find(key, check)
        return np.where(there, place, 0)[back], ~there[back] | (pre.check != check[back])


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        byte_level(path)
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = Known(np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32, MEMORY, self._ids)

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids end to end (uint32), and the number of each text's."""
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        pre = PreTokens(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        place, odd = self.known.look_up(pre)
        if odd.any():
            whole |= set(pre.text[odd].tolist())
        memo = self.known.memo
        size, at = memo.size[place].astype(np.int64), memo.at[place]
        total = int(size.sum())
        shift = at - (np.cumsum(size) - size)
        ids = memo.flat[np.repeat(shift, size) + np.arange(total)].astype(np.uint32)
        count = np.bincount(pre.text, weights=size, minlength=len(texts)).astype(np.int64) if total else np.zeros(len(texts), np.int64)
        if whole:
            cut = np.concatenate([[0], np.cumsum(count)])
            parts = [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]
            rest = sorted(whole)
            for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.uint32)
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, count


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text: ids, and the n + 1 offsets of the texts."""
    offsets = np.concatenate([[0], np.cumsum(count + 1)])
    out = np.full(int(offsets[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets
