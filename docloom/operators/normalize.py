"""Normalising stored Markdown, row by row: no exchange, and rows need no key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from docloom.functions import rules as R
from docloom.operators.text_markdown import _per_row, page_markdown
from docloom.operators.textrules import SPACES

_HIDDEN = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), R.INVISIBLE))


def normalized(markdown: str) -> str:
    """Lines trimmed, invisible characters gone and runs of blank lines as one, but for what lies inside code fences."""
    out: list[str] = []
    inside = blank = False
    lines = markdown.replace("\r", "").split("\n")
    if lines[-1] == "":
        lines.pop()
    for line in lines:
        clean = _HIDDEN.sub("", line.rstrip(SPACES))
        fence = clean.lstrip(SPACES).startswith("```")
        if inside and not fence:
            out.append(line)
            blank = False
            continue
        bare = clean.strip(SPACES)
        if fence:
            out.append(line if inside else clean)
            inside, blank = not inside, False
        elif bare or not blank:
            out.append(bare)
            blank = not bare
    return "\n".join(out).rstrip(SPACES) + "\n"


def with_normalized(df: DataFrame, markdown: str = "markdown", to: str = "body") -> DataFrame:
    """df with a column more. A null text gives a null; an empty one gives one line feed. Rows are worked on one by one, whatever their keys."""
    return _per_row(df, markdown, to, "string", normalized)


def with_text_body(df: DataFrame, text: str = "text", to: str = "body", repair: bool = True, keep: bool = True) -> DataFrame:
    """df with the normalised Markdown of its plain texts, both steps in one worker; without keep the text goes."""
    return _per_row(df, text, to, "string", lambda x: normalized(page_markdown(x, repair)), keep)
