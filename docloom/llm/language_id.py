"""Language identification of words by a linear-chain conditional random field, and of texts by their words.

A word (a run of letters) has hashed features: affixes, character n-grams, and itself (the lexicon).
Chains are windows of consecutive words. Transition weights are learned from training chains that
switch between texts, so that a chain may change language where its words say so. Forward-backward
gives each word's distribution; a text's language is the one with the largest mean.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import char_classes, mix, span_hash, steps

#: Hashed features, words of a chain, labelled texts of each language and words of them that training takes at most.
FEATURES, CHAIN, TRAIN_TEXTS, TRAIN_WORDS = 1 << 18, 64, 400, 100_000
#: Bytes of a text that training takes, and languages that it learns, at most: the most frequent ones.
TRAIN_BYTES, LANGUAGES = 1 << 18, 256
UNKNOWN = "und"


@lru_cache(1)
def lower_case() -> np.ndarray:
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in np.flatnonzero(char_classes() == 1).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, and text number, start and end of every run of letters."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)  # the joint is no letter
    letter = char_classes()[codes] == 1
    padded = np.concatenate([[False], letter, [False]])
    start, end = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return lower_case()[codes], np.searchsorted(np.cumsum(size), start, side="right"), start, end


def code_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(codes.view(np.uint8), 4 * start, 4 * end)[0]


def features(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of the spans: the word, its first and last 1 to 3 letters, its 1- to 3-grams."""
    n, length = len(start), end - start
    number = np.arange(n)
    rows, values = [number], [code_hash(codes, start, end)]
    inner = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    owner = np.repeat(number, length)
    rolled = np.zeros(len(inner), np.uint64)
    for size in (1, 2, 3):
        ok = inner + size <= end[owner]
        inner, owner, rolled = inner[ok], owner[ok], rolled[ok]
        rolled = mix(rolled + codes[inner + size - 1].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(size))
        rows.append(owner)
        values.append(rolled)
        first, last = inner == start[owner], inner + size == end[owner]
        rows += [owner[first], owner[last]]
        values += [mix(rolled[first] + np.uint64(101)), mix(rolled[last] + np.uint64(202))]
    return np.concatenate(rows), (np.concatenate(values) % np.uint64(FEATURES)).astype(np.int64)


def word_scores(weights: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    row, value = features(codes, start, end)
    return np.stack([np.bincount(row, weights=weights[value, k], minlength=len(start)) for k in range(weights.shape[1])], 1)


def forward_backward(scores: np.ndarray, transition: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of chains scores[chain, place, label] with the given lengths, and the expected transitions."""
    chains, places, k = scores.shape
    held = np.arange(places) < length[:, None]
    local = np.exp(np.clip(scores - scores.max(2, keepdims=True), -60, 0))
    step = np.exp(transition - transition.max())
    forward, backward = np.empty_like(local), np.empty_like(local)
    now = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    forward[:, 0] = now
    for t in range(1, places):
        now = (now @ step) * local[:, t] + 1e-300
        now /= now.sum(1, keepdims=True)
        forward[:, t] = now
    now = np.full((chains, k), 1.0 / k)
    expected = np.zeros((k, k))
    for t in range(places - 1, -1, -1):
        backward[:, t] = now
        if t:
            carried = local[:, t] * now
            pair = forward[:, t - 1, :, None] * step * carried[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True) + 1e-300
            expected += (pair * held[:, t, None, None]).sum(0)
            before = carried @ step.T + 1e-300
            now = np.where(held[:, t, None], before / before.sum(1, keepdims=True), now)
    both = forward * backward + 1e-300
    return both / both.sum(2, keepdims=True), expected


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray) -> None:
        self.labels, self.weights, self.transition = labels, weights, transition

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and label distribution of every word."""
        codes, text, start, end = letter_words(texts)
        if not len(start):
            return text, np.zeros((0, len(self.labels)))
        key, first, back = np.unique(code_hash(codes, start, end), return_index=True, return_inverse=True)
        order = np.argsort(first)  # spans in rising order
        scores = np.empty((len(key), len(self.labels)))
        scores[order] = word_scores(self.weights, codes, start[first[order]], end[first[order]])
        count = np.bincount(text, minlength=len(texts))
        place = np.arange(len(text)) - (np.cumsum(count) - count)[text]
        chains = -(-count // CHAIN)
        chain = (np.cumsum(chains) - chains)[text] + place // CHAIN
        table = np.zeros((int(chains.sum()), CHAIN, len(self.labels)))
        table[chain, place % CHAIN] = scores[back]
        marginal, _ = forward_backward(table, self.transition, np.bincount(chain, minlength=len(table)))
        return text, marginal[chain, place % CHAIN]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language, its mean share of the words, and how sure the words are: the mean of each one's likeliest label."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        text, each = self.words(texts)
        count = np.bincount(text, minlength=len(texts))
        mean = np.stack([np.bincount(text, weights=each[:, k], minlength=len(texts)) for k in range(len(self.labels))], 1) / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        sure = np.bincount(text, weights=each.max(1), minlength=len(texts)) / np.maximum(count, 1)
        return [self.labels[b] if c else UNKNOWN for b, c in zip(best, count, strict=True)], np.where(count > 0, np.clip(mean.max(1), 0, 1), 0.0), sure


def train(texts: list[str], langs: list[str], *, seed: int = 7, epochs: int = 2, batch: int = 64, rate: float = 0.3, most_words: int = TRAIN_WORDS) -> Model:
    """Fit by AdaGrad on the conditional likelihood of chains put together from stretches of the texts.

    Of each language the stretches, in a seeded random order, are taken until most_words words.
    """
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((0, 0)))
    rnd, k = np.random.default_rng(seed), len(labels)
    codes, text, start, end = letter_words(texts)
    gold = np.array([labels.index(x) for x in langs])[text]
    weights, transition = np.zeros((FEATURES, k)), np.zeros((k, k))
    g_weights, g_transition = np.full((FEATURES, k), 1e-2), np.full((k, k), 1e-2)
    # words by first occurrence, so that those of a batch are spans in rising order
    _, first, number = np.unique(code_hash(codes, start, end), return_index=True, return_inverse=True)
    number, first = np.argsort(np.argsort(first))[number], np.sort(first)
    cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    stretches = [(a, min(a + size, z)) for b, z in zip(cut, [*cut[1:], len(text)], strict=True) for a, size in _stretches(b, z, rnd)]
    taken, kept = np.zeros(k, np.int64), []
    for i in rnd.permutation(len(stretches)):
        a, b = stretches[i]
        if taken[gold[a]] < most_words:
            taken[gold[a]] += b - a
            kept.append((a, b))
    for _ in range(epochs):
        order = np.concatenate([np.arange(*kept[i]) for i in rnd.permutation(len(kept))]) if kept else np.zeros(0, np.int64)
        for at in range(0, len(order), batch * CHAIN):
            part = order[at : at + batch * CHAIN]
            n_chains = -(-len(part) // CHAIN)
            size = np.minimum(CHAIN, len(part) - np.arange(n_chains) * CHAIN)
            words, back = np.unique(number[part], return_inverse=True)
            row, value = features(codes, start[first[words]], end[first[words]])
            used, at_used = np.unique(value, return_inverse=True)  # a step touches no other feature
            now = weights[used]
            score = np.stack([np.bincount(row, weights=now[at_used, j], minlength=len(words)) for j in range(k)], 1)[back]
            table = np.zeros((n_chains * CHAIN, k))
            table[: len(part)] = score
            marginal, expected = forward_backward(table.reshape(n_chains, CHAIN, k), transition, size)
            miss = marginal.reshape(-1, k)[: len(part)].copy()
            miss[np.arange(len(part)), gold[part]] -= 1
            missed = np.stack([np.bincount(back, weights=miss[:, j], minlength=len(words)) for j in range(k)], 1)
            slope = np.stack([np.bincount(at_used, weights=missed[row, j], minlength=len(used)) for j in range(k)], 1) / n_chains
            g_weights[used] += slope**2
            weights[used] = now - rate * slope / np.sqrt(g_weights[used])
            seen = np.zeros((k, k))
            inside = np.arange(len(part) - 1) % CHAIN != CHAIN - 1
            np.add.at(seen, (gold[part[:-1]][inside], gold[part[1:]][inside]), 1)
            slope = (expected - seen) / n_chains
            g_transition += slope**2
            transition -= rate * slope / np.sqrt(g_transition)
    return Model(labels, weights.astype(np.float32), transition)


def _stretches(begin: int, end: int, rnd: np.random.Generator) -> Iterator[tuple[int, int]]:
    at = int(begin)
    while at < end:
        size = int(rnd.integers(8, 48))
        yield at, size
        at += size


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_TEXTS) -> Model:
    """Fit on at most about twice per_language texts of each language, chosen by a hash of the id.

    Texts of more than TRAIN_BYTES are not taken; of more than LANGUAGES labels only the most frequent are
    learned. Rows without text or label play no part; with none left nothing is learned.
    """
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where(f"octet_length(t) <= {TRAIN_BYTES} AND l IS NOT NULL")
    rates = {r.l: max(1, r["count"] // per_language) for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()}
    if not rates:
        return train([], [])
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("l")]
    picked = rows.where(F.pmod(F.xxhash64("i", F.lit(5)), rate) == 0).orderBy("i", "t").collect()
    return train([r.t for r in picked], [r.l for r in picked])


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text; one row for each row.

    A null text, or one without letters, is `und` with score 0; so is every text where nothing was
    learned. Equal texts get equal results; an empty table gives an empty one; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            lang, score, _ = sent.value.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words (array of start, end, lang, score): every word of code-switched text with its likeliest language.

    Places count code points. A null text, or one without letters, has no words, nor has any text where
    nothing was learned. One row for each row; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            _, text, start, end = letter_words(texts)
            if not sent.value.labels:
                text, start, end = text[:0], start[:0], end[:0]
            each = sent.value.words(texts)[1] if len(text) else np.zeros((0, 1))
            shift = np.cumsum([0, *(len(t) + 1 for t in texts)])[text]
            names = np.array(sent.value.labels or [UNKNOWN], object)[each.argmax(1)]
            flat = pa.StructArray.from_arrays([pa.array((start - shift).astype(np.int32)), pa.array((end - shift).astype(np.int32)), pa.array(names, pa.string()), pa.array(each.max(1, initial=0.0))], fields=list(kind))
            cuts = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), flat)], ["doc_id", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, words array<struct<start:int,end:int,lang:string,score:double>>")


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows whose words are sure of their languages, by at least least in the mean; the same columns.

    A text that mixes languages stays if its words are clear. Null texts, those without letters and,
    where nothing was learned, all texts go. Rows are judged one by one: repeated ones all stay or all go.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            lang, _, sure = sent.value.predict([t or "" for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array((np.array(lang) != UNKNOWN) & (sure >= least)))

    return docs.mapInArrow(work, docs.schema)
