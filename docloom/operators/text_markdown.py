"""Plain text and PDF pages to Markdown: the folds over lines, and their Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.rules import ROSTER_LABELS
from docloom.operators import textrules as T
from docloom.operators.batches import give_back, small_batches, steps

ITEMS = ("toc", "bullet", "numbered")


def split_lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def reflow(page: str) -> list[str]:
    """Soft-wrapped lines put together into paragraphs."""
    out, held = [], ""
    for line in (x.strip(T.SPACES) for x in split_lines(page)):
        if held and line and T.continues(held, line):
            held = held[:-1] + line if held.endswith("-") else f"{held} {line}"
            continue
        if held:
            out.append(held)
        held = line
    return [*out, held] if held else out


def blocks(paragraphs: list[str], repair: bool = True) -> Iterator[tuple[str, str]]:
    """(kind, Markdown) of each paragraph. Lines under a roster heading become list items until one doesn't fit."""
    roster = False
    for paragraph in paragraphs:
        raw = paragraph.strip(T.SPACES)
        if not raw or T.page_marker(raw):
            continue
        if entry := T.toc_entry(raw):
            yield "toc", f"- {entry}"
            continue
        line = T.repair_word_breaks(raw) if repair else raw
        if item := T.bullet(line):
            yield "bullet", f"- {item}"
        elif item := T.numbered(line):
            yield "numbered", f"1. {item}"
        elif head := T.heading(line):
            roster = head[1].lower() in ROSTER_LABELS
            yield "heading", f"{'#' * head[0]} {head[1]}"
        elif roster and T.roster_line(line):
            yield "roster", f"- {line}"
        else:
            roster = False
            yield ("subtitle", f"## {line}") if T.subtitle(line) else ("paragraph", line)


def page_markdown(page: str, repair: bool = True) -> str:
    """One page: neighbouring list items on lines of their own, a blank line between all other blocks."""
    out, before = [], None
    for kind, text in blocks(reflow(page), repair):
        if before:
            out.append("\n" if kind in ITEMS and (before in ITEMS or before == "roster") else "\n\n")
        out.append(text)
        before = kind
    return "".join(out).rstrip(T.SPACES)


def document_title(page: str, repair: bool = True) -> str | None:
    found = [x for x in (line.strip(T.SPACES) for line in split_lines(page)) if x][:8]
    if not found or not 12 <= T.size(found[0]) <= 120 or found[0].endswith("."):
        return None
    first = found[0]
    again = sum(x.lower() == first.lower() or first in x for x in found)
    words = T.split_words(first)
    titled = sum("A" <= w[0] <= "Z" for w in words) / len(words)
    if again < 2 and not (len(found) <= 4 and titled > 0.5):
        return None
    return T.repair_word_breaks(first) if repair else first


def without_title(body: str, title: str) -> str:
    low = title.lower()
    kept = (b for b in body.split("\n\n") if (x := b.strip(T.SPACES).lower()) and x not in low and low not in x)
    return "\n\n".join(kept)


def dedupe_paragraphs(text: str) -> str:
    out: list[str] = []
    for block in (b.strip(T.SPACES) for b in text.split("\n\n")):
        if block and (not out or out[-1] != block):
            out.append(block)
    return "\n\n".join(out)


def pages_markdown(pages: list[str], repair: bool = True) -> str:
    """Pages under a rule and a page comment each, but for the first; the first page's title on top."""
    out = []
    for number, page in enumerate(pages, 1):
        text = page.strip(T.SPACES)
        if not text:
            continue
        body = page_markdown(text, repair)
        if number == 1 and (title := document_title(text, repair)):
            body = f"# {title}\n\n{without_title(body, title)}"
        out.append(f"\n\n---\n\n<!-- Page {number} -->\n\n{body}" if out else body)
    return dedupe_paragraphs("".join(out))


def _per_row(df: DataFrame, of: str, to: str, kind: str, work: Callable, keep: bool = True) -> DataFrame:
    """df with a column more, worked out from another one in steps of bounded size; null stays null. Without keep that other column goes."""
    small_batches(df.sparkSession)
    at = df.columns.index(of)
    kept = [i for i in range(len(df.columns)) if keep or i != at]
    names = [*(df.columns[i] for i in kept), to]
    added = df.select("*", F.lit(None).cast(kind).alias(to)).schema
    result = StructType([f for i, f in enumerate(added) if keep or i != at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.string() if kind == "string" else pa.list_(pa.string())
        for batch in batches:
            for part in steps(batch):
                made = [None if x is None else work(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(made, arrow)], names)
        give_back()

    return df.mapInArrow(run, result)


def with_paragraphs(df: DataFrame, text: str = "text", to: str = "paragraphs") -> DataFrame:
    return _per_row(df, text, to, "array<string>", reflow)


def with_repaired(df: DataFrame, text: str = "text", to: str = "repaired", keep: bool = True) -> DataFrame:
    return _per_row(df, text, to, "string", T.repair_word_breaks, keep)


def with_text_markdown(df: DataFrame, text: str = "text", to: str = "markdown", repair: bool = True, keep: bool = True) -> DataFrame:
    return _per_row(df, text, to, "string", lambda x: page_markdown(x, repair), keep)


def with_pages_markdown(df: DataFrame, pages: str = "pages", to: str = "markdown", repair: bool = True) -> DataFrame:
    return _per_row(df, pages, to, "string", lambda x: pages_markdown([p or "" for p in x], repair))
