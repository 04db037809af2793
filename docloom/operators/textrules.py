"""The line rules in Python, for the sequential steps; the same rules as docloom.functions.rules."""

from __future__ import annotations

import re

from docloom.functions.rules import BULLETS, CHAPTER_PREFIXES, LABELS, STOP_WORDS

#: Unicode White_Space, which str.strip() exceeds by four control characters.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[{SPACES}]+")
_BULLET = re.compile(f"[{BULLETS}] (.*)", re.S)
_NUMBER = re.compile(r"([0-9]+)[.)](.*)", re.S)
_HASHES = re.compile(r"(#{1,6})(?!#)(.*)", re.S)
_ROMAN = re.compile(f"\\([{SPACES}]*[ivxlcdmIVXLCDM]+[{SPACES}]*\\)")
_PAGE = re.compile(f"page [{SPACES}]*\\+?([0-9]+)")
_JOINT = re.compile(r"[A-Za-z]{2,3}")
_UPPER = re.compile("[A-Z]")
_LOWER_OR_DIGIT = re.compile("[a-z0-9]")


def size(text: str) -> int:
    return len(text.encode())


def split_words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text) if w]


def bullet(line: str) -> str | None:
    m = _BULLET.fullmatch(line)
    return (m and m[1].strip(SPACES)) or None


def _reads_as_heading(line: str, digits: int) -> bool:
    after = line.partition(".")[2].strip(SPACES)
    return digits > 2 or (size(after) > 3 and bool(_UPPER.match(after)))


def numbered(line: str) -> str | None:
    m = _NUMBER.fullmatch(line)
    rest = m[2].strip(SPACES) if m else ""
    return rest if rest and not _reads_as_heading(line, len(m[1])) else None


def all_caps(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return 3 <= len(letters) <= 80 and all(c.isupper() for c in letters) and not line.endswith(".")


def heading(line: str) -> tuple[int, str] | None:
    if not line or size(line) > 120:
        return None
    marked = _HASHES.fullmatch(line)
    if marked and (title := marked[2].strip(SPACES)):
        return len(marked[1]), title
    low = line.lower()
    if low.startswith(CHAPTER_PREFIXES):
        return 1, line
    number = _NUMBER.fullmatch(line)
    section = number and size(rest := number[2].strip(SPACES)) >= 3 and _UPPER.match(rest)
    return (2, line) if low in LABELS or section or all_caps(line) else None


def starts_block(line: str) -> bool:
    return bool(bullet(line) or numbered(line) or heading(line))


def continues(before: str, line: str) -> bool:
    """Whether line carries on the paragraph held in before."""
    if starts_block(line) or starts_block(before):
        return False
    return before.endswith("-") or (not before.rstrip(SPACES).endswith((".", "!", "?", ":", ";")) and bool(_LOWER_OR_DIGIT.match(line)))


def page_marker(line: str) -> bool:
    number = _PAGE.fullmatch(line.lower())
    return bool(_ROMAN.fullmatch(line)) or bool(number and int(number[1]) < 1 << 32)


def toc_entry(line: str) -> str | None:
    title, gap, page = line.rpartition("  ")
    title, page = title.strip(SPACES), page.strip(SPACES)
    if not gap or size(title) < 3 or re.search("[^0-9]", page) or re.match("[0-9]", title):
        return None
    return f"{title} (p. {page})"


def roster_line(line: str) -> bool:
    return 6 <= size(line) <= 100 and bool(_UPPER.match(line)) and not line.endswith(".")


def subtitle(line: str) -> bool:
    return 8 <= size(line) <= 100 and line.startswith("(") and not line.endswith(".")


def _open_joint(token: str) -> bool:
    """A short token that a page break may have cut off a word."""
    return bool(_JOINT.fullmatch(token)) and not token.isupper() and token not in STOP_WORDS and (token[0].isupper() or token.islower())


def repair_word_breaks(text: str) -> str:
    out: list[str] = []
    for word in split_words(text):
        if out and "a" <= word[0] <= "z" and _open_joint(out[-1]):
            out[-1] += word
        else:
            out.append(word)
    return " ".join(out)
