"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary packs badly.

Ordinary words and identifiers take few tokens for their length under a byte-pair vocabulary, random
strings take many. A run of key characters whose characters-per-token ratio is low is reported unless
it is a known kind of digest or identifier: bare hexadecimal of a digest's length, a UUID or a number.
Runs of letters in the shape of words are held to a somewhat lower ratio.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import kept, steps

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_BETWEEN = re.compile(r"[^=]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))

#: Share of the ratio that runs in the shape of words are held to: 2.0 at a ratio of 2.2.
LETTERS = 2.0 / 2.2


def vocabulary(path: str, pattern: str):
    """The tokenizer of a tiktoken vocabulary file."""
    return kept(("vocabulary", path, pattern), lambda: _load(path, pattern))


def _load(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order: of each kind the leftmost matches, then those long enough."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]  # a run's only match is the whole run
    return sorted(out)


def looks_ordinary(run: str) -> bool:
    """Known digests and identifiers, and numbers."""
    if run.isdigit() or _UUID.fullmatch(run):
        return True
    if len(run) in DIGESTS and all(c in "0123456789abcdef" for c in run.lower()):
        return True
    return False


def wordlike(run: str) -> bool:
    """Letters with at most one digit, or digits with at most one letter, whose case doesn't change often."""
    digits, letters = sum(c.isdigit() for c in run), sum(c.isalpha() for c in run)
    if digits >= 2 and letters >= 2:
        return False
    return sum(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False)) < 3


def random_spans(text: str, encoding, ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for run in RUN.finditer(text):
        for part in _BETWEEN.finditer(run[0]):
            word = part[0].strip("-_/+")
            if len(word) < 16 or looks_ordinary(word):
                continue
            least = ratio * LETTERS if wordlike(word) else ratio
            if len(word) < least * len(encoding.encode_ordinary(word)):
                start = run.start() + part.start() + part[0].index(word)
                out.append((start, 3, start + len(word)))
    return out


def find_secrets(text: str, encoding, ratio: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: base ones and the random strings that overlap none of them."""
    base = base_spans(text)
    found = [s for s in random_spans(text, encoding, ratio) if all(s[2] <= b[0] or s[0] >= b[2] for b in base)]
    return base, sorted(base + found)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, vocab: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", ratio: float = 2.2, mark: str = "[secret]") -> DataFrame:
    """doc_id, base_spans, spans (arrays of kind, start, end in code points), redacted text; one row for each row.

    A null text counts as empty and gives empty arrays. Repeated rows and ids give repeated results; an
    empty table gives an empty result; other columns are ignored. In the redacted text a mark stands
    for each group of overlapping spans.
    """
    one = "array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocab, pattern)
        for batch in steps(batches, keeps=True):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [find_secrets(t, encoding, ratio) for t in texts]
            named = [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in column] for column in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named[0], kind), pa.array(named[1], kind), pa.array([redacted(t, s, mark) if s else t for t, (_, s) in zip(texts, found, strict=True)])], ["doc_id", "base_spans", "spans", "redacted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id long, base_spans {one}, spans {one}, redacted string")


def digest(found: DataFrame) -> DataFrame:
    """The spans' counts, and their text form kind:start:end joined by commas, the base ones' as SHA-256."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))


def scrub(docs: DataFrame, vocab: str, pattern: str, *, text_col: str = "text", size_col: str | None = None, **options) -> DataFrame:
    """The same rows and columns with the secrets in text_col replaced; null texts stay null.

    size_col: a column that holds the text's length, set anew where the text changed.
    """
    ratio, mark = options.get("ratio", 2.2), options.get("mark", "[secret]")
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col else -1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocab, pattern)
        for batch in steps(batches, text_col, keeps=True):
            texts = batch.column(at).to_pylist()
            new = [redacted(t, s, mark) if t and (s := find_secrets(t, encoding, ratio)[1]) else t for t in texts]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if size_at >= 0:
                sizes = [s if a is b else len(b) for s, a, b in zip(batch.column(size_at).to_pylist(), texts, new, strict=True)]
                batch = batch.set_column(size_at, batch.schema.field(size_at), pa.array(sizes, batch.schema.field(size_at).type))
            yield batch

    return docs.mapInArrow(work, docs.schema)
