"""The text, quality, markup and packaging rules as SQL expressions of their operands.

Every rule takes a dialect and operand expressions and gives an expression. `column` makes a Spark
column of a rule. Lengths called bytes are UTF-8 bytes, others are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPARK, Dialect

# White_Space, invisible characters, readable punctuation, labels, stop words, limits.
WS = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), WS), c))
INVISIBLE = r"[\x{feff}\x{200b}\x{200c}\x{200d}\x{2060}\x{ad}]"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
READABLE_PUNCTUATION = ".,;:!?-_()[]{}#*|/\\'\"%&@+=<>"
READABLE = LETTERS + "0123456789 \n\r\t" + READABLE_PUNCTUATION
BULLETS = "-*•○▪▫"
CHAPTER_PREFIXES = ("chapter ", "section ", "part ", "appendix ")
LABELS = ("contents", "table of contents", "panel", "staff", "disclaimer", "overview", "introduction", "summary of the recommendations", "ies practice guide")
ROSTER_LABELS = ("panel", "staff")
STOP_WORDS = ("and", "for", "the", "with", "from", "not")
EXTENSIONS = ("txt", "md", "csv", "docx", "pdf", "epub", "mobi", "azw3", "azw")
STRIPPED_TAGS = ("script", "style", "svg", "nav", "header", "footer", "aside")
KINDLE_TAGS = ("script", "style")
CHAPTER_BREAKS = (("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</div>", "\n\n"), ("</li>", "\n"), *((f"</h{i}>", "\n\n") for i in range(1, 7)))
KINDLE_BREAKS = (("<br>", "\n"), ("<br/>", "\n"), ("<br />", "\n"), ("</p>", "\n\n"), ("</div>", "\n\n"))
MAX_FILE_BYTES, MAX_FILES, QUALITY_CHARS, QUALITY_WORDS = 50 * 1024 * 1024, 25, 8000, 500
LOW_QUALITY, GARBAGE_CHARS, GARBAGE_WORDS = 0.75, 0.65, 0.25

# Our own wording.
MESSAGES = {
    "UNSUPPORTED_FILE": "Files of this type are not converted.",
    "FILE_TOO_LARGE": "The file exceeds the size limit.",
    "NO_READABLE_TEXT": "No readable text was found; scanned pages are not recognised.",
    "PASSWORD_PROTECTED": "The file is encrypted or under copy protection.",
    "CONVERSION_FAILED": "The file could not be converted.",
    "CANCELLED": "The conversion was stopped.",
    "TEMP_FILE_ERROR": "A temporary file could not be used.",
    "ZIP_CREATION_FAILED": "The archive could not be written.",
    "TIMEOUT_EXCEEDED": "The conversion took too long.",
    "ZIP_BOMB_DETECTED": "The archive unpacks to too much data.",
    "OUTPUT_ALREADY_EXISTS": "The output folder exists already.",
    "VALIDATION_ERROR": "The input is not valid.",
}
WARNING_MARK = "> **Conversion warning:**"
REVIEW_PREFIX = "Converted, but please review: "
LOW_QUALITY_WARNING = "Much of the text may be unreadable."
GARBAGE_PREVIEW = "No readable preview."


def column(rule: Callable[..., str], *names: str, **options) -> Column:
    """A rule as a column of the named columns."""
    return F.expr(rule(SPARK, *names, **options))


def quoted(d: Dialect, values) -> str:
    return "(" + ", ".join(map(d.lit, values)) + ")"


# ---- white space and lines


def trim(d, x):
    return d.trim(x, f"^{WS}+|{WS}+$", "BOTH", WS_CHARS)


def rtrim(d, x):
    return d.trim(x, f"{WS}+$", "TRAILING", WS_CHARS)


def blank(d, x):
    return f"(NOT {d.has(x, NOT_WS)})"


def words(d, x):
    """White-space separated words; none for a blank text."""
    return d.keep(d.split(trim(d, d.squeeze(x, WS, WS_CHARS)), " "), "w", "w <> ''")


def lines(d, x):
    """Lines without a final empty one, a carriage return before the line feed removed."""
    unix = f"replace({x}, {d.lit(chr(13) + chr(10))}, {d.lit(chr(10))})"
    body = f"CASE WHEN right({unix}, 1) = {d.lit(chr(10))} THEN substring({unix}, 1, length({unix}) - 1) ELSE {unix} END"
    return d.split(body, "\n")


# ---- text quality


def _readable_class() -> str:
    escaped = "".join("\\" + c for c in READABLE_PUNCTUATION)
    return f"[^A-Za-z0-9 \\n\\r\\t{escaped}]"


def sample(d, x):
    return f"substring({x}, 1, {QUALITY_CHARS})"


def readable_ratio(d, x):
    s = sample(d, x)
    return f"CASE WHEN length({x}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({d.among(s, _readable_class(), READABLE)} AS DOUBLE) / length({s}) END"


def word_share(d, ws):
    """Of an array of words, the share that are mostly letters."""
    letters = d.among("w", "[^A-Za-z]", LETTERS)
    good = d.keep(ws, "w", f"{letters} * 2 >= greatest(4, length(w))")  # two letters at least, and half of the word
    return f"CASE WHEN {d.size(ws)} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({d.size(good)} AS DOUBLE) / {d.size(ws)} END"


def word_like_ratio(d, x):
    return d.let(d.slice(words(d, x), 1, QUALITY_WORDS), "ws", lambda ws: word_share(d, ws))


def measured(d, source, text="text"):
    """source with quality_sample, readable, word_like and spaces, each computed once."""
    s = "quality_sample"
    one = f"(SELECT *, {sample(d, text)} AS {s} FROM {source})"
    two = f"(SELECT *, {d.slice(words(d, s), 1, QUALITY_WORDS)} AS quality_words, {readable_ratio(d, s)} AS readable, CASE WHEN length({s}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(length({s}) - length({d.drop(s, WS, WS_CHARS)}) AS DOUBLE) / length({s}) END AS spaces FROM {one} AS g1)"
    return f"(SELECT *, {word_share(d, 'quality_words')} AS word_like FROM {two} AS g2)"


def garbage(d):
    """Over a measured source: no text of words."""
    s = "quality_sample"
    return f"({d.bytes(trim(d, s))} >= 20 AND ((readable < {GARBAGE_CHARS} AND word_like < {GARBAGE_WORDS}) OR ({d.bytes(s)} > 80 AND spaces < 0.03 AND word_like < 0.2)))"


def quality_warning(d, x):
    return f"CASE WHEN {readable_ratio(d, x)} < {LOW_QUALITY} THEN {d.lit(LOW_QUALITY_WARNING)} END"


def client_garbage(d, x):
    """The page's own test: first 4000 characters, ratio below 0.55, short texts pass."""
    s = f"substring({x}, 1, 4000)"
    return f"(length({x}) >= 20 AND CAST({d.among(s, _readable_class(), READABLE)} AS DOUBLE) / length({s}) < 0.55)"


# ---- blocks of plain text; operands are trimmed lines


def bullet(d, l):
    return f"nullif({trim(d, d.get(l, '^[' + BULLETS + '] (.*)$'))}, '')"


def _after_dot(d, l):
    return trim(d, d.get(l, r"^[^.]*\.(.*)$"))


def heading_number(d, l):
    """A numbered line that reads as a heading rather than as a list item."""
    rest = _after_dot(d, l)
    return f"({d.has(l, '^[0-9]{3,}')} OR ({d.bytes(rest)} > 3 AND {d.has(rest, '^[A-Z]')}))"


def numbered(d, l):
    rest = trim(d, d.get(l, "^[0-9]+[.)](.*)$"))
    return f"CASE WHEN {rest} <> '' AND NOT {heading_number(d, l)} THEN {rest} END"


def section_number(d, l):
    rest = trim(d, d.get(l, "^[0-9]+[.)](.*)$"))
    return f"({d.bytes(rest)} >= 3 AND {d.has(rest, '^[A-Z]')})"


def all_caps(d, l):
    if d.name == "spark":  # most lines end at their first small letter
        few = d.has(l, r"^(?:[^\p{L}]*+\p{L}){3,80}+[^\p{L}]*+\z")
        return f"(NOT {d.has(l, '[\\p{L}&&[^\\p{Lu}]]')} AND {few} AND NOT {d.has(l, '[.]$')})"
    letters, capitals = f"length({d.sub(l, '[^\\p{L}]')})", f"length({d.sub(l, '[^\\p{Lu}]')})"
    return f"({letters} BETWEEN 3 AND 80 AND {letters} = {capitals} AND NOT {d.has(l, '[.]$')})"


def hash_marks(d, l):
    return d.get(l, "^(#{1,6})[^#]")


def heading_level(d, l, low=None, hashes=None):
    """The line's level as a heading, or null; low and hashes name columns that hold its lower case and its hash marks."""
    low, hashes = low or f"lower({l})", hashes or hash_marks(d, l)
    prefixed = " OR ".join(f"{low} LIKE {d.lit(p + '%')}" for p in CHAPTER_PREFIXES)
    return (
        f"CASE WHEN {l} = '' OR {d.bytes(l)} > 120 THEN NULL WHEN {hashes} <> '' THEN length({hashes}) WHEN {prefixed} THEN 1 "
        f"WHEN {low} IN {quoted(d, LABELS)} THEN 2 WHEN {section_number(d, l)} THEN 2 WHEN {all_caps(d, l)} THEN 2 END"
    )


def heading_title(d, l):
    return f"CASE WHEN {heading_level(d, l)} IS NULL THEN NULL WHEN {hash_marks(d, l)} <> '' THEN {trim(d, d.get(l, '^#{1,6}(.*)$'))} ELSE {l} END"


def starts(d, source, l="line"):
    """source with starts: whether its trimmed line opens a block of its own. Parts that are used twice are columns, worked out once."""
    parts = f"(SELECT *, lower({l}) AS low, {hash_marks(d, l)} AS hashes, {numbered(d, l)} AS numbered FROM {source})"
    return f"(SELECT *, ({bullet(d, l)} IS NOT NULL OR numbered IS NOT NULL OR {heading_level(d, l, 'low', 'hashes')} IS NOT NULL) AS starts FROM {parts} AS p1)"


def merges(d, prev, line, prev_starts, line_starts):
    """Whether a line continues the one before it, by these two lines alone."""
    return f"(NOT {line_starts} AND NOT {prev_starts} AND ({d.has(prev, '-$')} OR (NOT {d.has(prev, '[.!?:;]$')} AND {d.has(line, '^[a-z0-9]')})))"


def page_marker(d, l):
    roman = d.has(l, f"^\\({WS}*[ivxlcdmIVXLCDM]+{WS}*\\)$")
    number = d.get(f"lower({l})", f"^page {WS}*\\+?([0-9]+)$")
    digits = d.sub(number, "^0+")
    return f"({roman} OR ({number} <> '' AND (length({digits}) < 10 OR (length({digits}) = 10 AND {digits} <= '4294967295'))))"


def toc_entry(d, l):
    title, page = trim(d, d.get(l, "^(.*)  (.*)$")), trim(d, d.get(l, "^(.*)  (.*)$", 2))
    return f"CASE WHEN {d.bytes(title)} >= 3 AND {d.has(page, '^[0-9]*$')} AND NOT {d.has(title, '^[0-9]')} THEN concat({title}, ' (p. ', {page}, ')') END"


def roster_line(d, l):
    return f"({d.bytes(l)} BETWEEN 6 AND 100 AND {d.has(l, '^[A-Z]')} AND NOT {d.has(l, '[.]$')})"


def subtitle(d, l):
    return f"({d.bytes(l)} BETWEEN 8 AND 100 AND {d.has(l, '^[(]')} AND NOT {d.has(l, '[.]$')})"


def blocks(d, source, l="line"):
    """source with toc, bullet, numbered, level, title and kind of its trimmed lines, each worked out once.

    The kind leaves out roster lines, which need the heading before them.
    """
    parts = f"(SELECT *, lower({l}) AS low, {hash_marks(d, l)} AS hashes FROM {source})"
    one = f"(SELECT *, {page_marker(d, l)} AS marker, {toc_entry(d, l)} AS toc, {bullet(d, l)} AS bullet, {numbered(d, l)} AS numbered, {heading_level(d, l, 'low', 'hashes')} AS level, {subtitle(d, l)} AS subtitle FROM {parts} AS b0)"
    two = f"(SELECT *, CASE WHEN hashes <> '' THEN {trim(d, d.get(l, '^#{1,6}(.*)$'))} ELSE {l} END AS title FROM {one} AS b1)"
    kind = (
        "CASE WHEN marker THEN 'marker' WHEN toc IS NOT NULL THEN 'toc' WHEN bullet IS NOT NULL THEN 'bullet' WHEN numbered IS NOT NULL THEN 'numbered' "
        "WHEN level IS NOT NULL THEN 'heading' WHEN subtitle THEN 'subtitle' ELSE 'paragraph' END"
    )
    return f"(SELECT *, {kind} AS kind FROM {two} AS b2)"


def block_markdown(d, l="line"):
    """Over a blocks source: the line as Markdown."""
    return (
        f"CASE kind WHEN 'toc' THEN concat('- ', toc) WHEN 'bullet' THEN concat('- ', bullet) WHEN 'numbered' THEN concat('1. ', numbered) "
        f"WHEN 'heading' THEN concat(repeat('#', CAST(level AS INT)), ' ', title) WHEN 'subtitle' THEN concat('## ', {l}) WHEN 'paragraph' THEN {l} END"
    )


def title_case_ratio(d, x):
    """Of the words, the share that begin with a capital."""
    if d.name == "spark":  # counted in the text as it is: a blank before each word, every capital as A
        n, titled = "(length(s) - length(replace(s, ' ', '')))", "(length(s) - length(replace(s, ' A', ' ')))"
        single = f"rtrim(concat(' ', {trim(d, d.squeeze(x, WS, WS_CHARS))}))"
        share = f"CASE WHEN s = '' THEN CAST(0 AS DOUBLE) ELSE CAST({titled} AS DOUBLE) / {n} END"
        return d.let(f"translate({single}, {d.lit(LETTERS[:26])}, {d.lit('A' * 26)})", "s", lambda _: share)
    ws = words(d, x)
    return f"CASE WHEN {d.size(ws)} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({d.size(d.keep(ws, 'w', d.has('w', '^[A-Z]')))} AS DOUBLE) / {d.size(ws)} END"


def title_lines(d, x):
    return d.slice(d.keep(d.each(lines(d, x), "l", trim(d, "l")), "l", "l <> ''"), 1, 8)


def strip_title_blocks(d, body, title):
    b, t = f"lower({trim(d, 'b')})", f"lower({title})"
    return d.join(d.keep(d.split(body, "\n\n"), "b", f"{trim(d, 'b')} <> '' AND NOT contains({t}, {b}) AND NOT contains({b}, {t})"), "\n\n")


# ---- markup


def strip_blocks(d, x, tags=STRIPPED_TAGS):
    for tag in tags:
        x = d.sub(x, f"(?is)<{tag}.*?</{tag}>")
    return x


def breaks(d, x, pairs=CHAPTER_BREAKS):
    for literal, by in pairs:
        x = f"replace({x}, {d.lit(literal)}, {d.lit(by)})"
    return x


def collapse_blank_lines(d, x):
    """Every line trimmed, runs of blank lines as one, none at the ends."""
    inner = WS.replace("\\n", "")
    x = d.sub(x, f"{inner}*\n{inner}*", "\n")
    return trim(d, d.sub(x, "\n{3,}", "\n\n"))


def drop_tags(d, x):
    return d.sub(d.sub(x, "<[^>]*>"), "(?s)<[^>]*$")


def html_markdown(d, x):
    x = breaks(d, strip_blocks(d, x))
    for i in range(1, 7):
        x = d.sub(x, f"(?i)<(?:[^>]*<)?{WS}*h{i}(?:[^a-z0-9<>][^<>]*)?>", "\n\n" + "#" * i + " ")
    x = d.sub(x, f"(?i)<(?:[^>]*<)?{WS}*li(?:[^a-z0-9<>][^<>]*)?>", "- ")
    return collapse_blank_lines(d, drop_tags(d, x))


def kindle_text(d, x):
    plain = collapse_blank_lines(d, drop_tags(d, breaks(d, strip_blocks(d, x, KINDLE_TAGS), KINDLE_BREAKS)))
    return f"CASE WHEN contains({x}, '<') AND contains({x}, '>') THEN {plain} ELSE {collapse_blank_lines(d, x)} END"


def kindle_titled(d, title, body):
    return f"CASE WHEN {blank(d, title)} OR lower({trim(d, title)}) = 'unknown' THEN {body} ELSE concat('# ', {trim(d, title)}, {d.lit(chr(10) * 2)}, {body}) END"


def href_path(d, base, href):
    x = d.sub(href, "(?s)#.*$")
    for code, by in (("%20", " "), ("%28", "("), ("%29", ")")):
        x = f"replace({x}, '{code}', '{by}')"
    return f"CASE WHEN {base} = '' THEN {d.sub(x, '^/+')} ELSE concat({base}, '/', {d.sub(x, '^/+')}) END"


def content_href(d, href):
    return d.has(f"lower({href})", r"\.(xhtml|html?|xml)$")


# ---- stored Markdown


def strip_frontmatter(d, x):
    """The text after a leading --- block; unchanged where there is none or it does not end."""
    cut = d.sub(x, f"(?s)^{WS}*---[\\n\\r]*(.*?)\\n---[\\n\\r]*(.*)$", "$2")
    return f"CASE WHEN {d.has(x, f'(?s)^{WS}*---[\\n\\r]*.*?\\n---')} THEN {cut} ELSE {x} END"


def strip_warning(d, x, mark=WARNING_MARK):
    """Without a warning quote on the first line, through the blank lines after it; trimmed."""
    start = f"starts_with({trim(d, d.get(x, '^([^\\n]*)'))}, {d.lit(mark)})".replace("starts_with", "startswith" if d.name == "spark" else "starts_with")
    inner = WS.replace("\\n", "")
    rest = d.sub(x, f"(?s)^.*?(?:\\n{inner}*\\n{WS}*|$)")
    return f"CASE WHEN {start} THEN {trim(d, rest)} ELSE {trim(d, x)} END"


def preview(d, x, mark=WARNING_MARK):
    return strip_warning(d, strip_frontmatter(d, x), mark)


def garbage_preview(d, body):
    """Over a source measured by its preview body."""
    return f"CASE WHEN {garbage(d)} THEN {d.lit(GARBAGE_PREVIEW)} ELSE {body} END"


def frontmatter(d, source_file, source_type, status, warning, body, by="docloom"):
    shown = f"CASE WHEN {status} IN ('good', 'partial') THEN {status} ELSE 'unknown' END"
    nl = d.lit("\n")
    return (
        f"concat('---', {nl}, 'source_file: ', {source_file}, {nl}, 'source_type: ', {source_type}, {nl}, 'converted_by: {by}', {nl}, 'status: ', {shown}, {nl}, '---', {nl}, {nl}, "
        f"coalesce({d.lit(WARNING_MARK + ' ')} || {warning} || {nl} || {nl}, ''), {body})"
    )


# ---- files and jobs


def extension(d, name):
    return f"lower({d.get(name, '^.+[.]([^.]*)$')})"


def hidden(d, path):
    return d.has(path, r"(^|/)[.][^/]*$")


def sanitized(d, name):
    return d.sub(d.get(name, "([^/]*)$"), "[^A-Za-z0-9._-]", "_")


def slug(d, name):
    stem = f"CASE WHEN {d.has(name, '^.+[.][^.]*$')} THEN {d.get(name, '^(.+)[.][^.]*$')} ELSE {name} END"
    return f"replace(replace(lower({stem}), ' ', '-'), '_', '-')"


def output_name(d, base_ext, n):
    return f"CASE WHEN {n} = 1 THEN concat({base_ext}, '.md') ELSE concat({base_ext}, '-', CAST({n} AS STRING), '.md') END"


def file_error(d, ext, size, limit=MAX_FILE_BYTES):
    return f"CASE WHEN {size} > least({limit}, {MAX_FILE_BYTES}) THEN 'FILE_TOO_LARGE' WHEN {ext} NOT IN {quoted(d, EXTENSIONS)} THEN 'UNSUPPORTED_FILE' END"


def status(d, error, warning):
    return f"CASE WHEN {error} = 'UNSUPPORTED_FILE' THEN 'unsupported' WHEN {error} IS NOT NULL THEN 'failed' WHEN {warning} IS NOT NULL THEN 'partial' ELSE 'good' END"


def message(d, error, warning):
    cases = " ".join(f"WHEN '{k}' THEN {d.lit(v)}" for k, v in MESSAGES.items())
    return f"CASE WHEN {error} IS NOT NULL THEN CASE {error} {cases} END WHEN {warning} IS NOT NULL THEN concat({d.lit(REVIEW_PREFIX)}, {warning}) END"


def job_status(d, total, partial, failed):
    return f"CASE WHEN {total} > 0 AND {failed} = {total} THEN 'failed' WHEN {failed} > 0 OR {partial} > 0 THEN 'partial_success' ELSE 'success' END"


def exit_code(d, job):
    return f"CASE {job} WHEN 'success' THEN 0 WHEN 'partial_success' THEN 1 WHEN 'failed' THEN 2 WHEN 'validation_error' THEN 3 ELSE 4 END"


def size_label(d, n):
    one = (lambda x: f"format_number({x}, '0.0')") if d.name == "spark" else (lambda x: f"printf('%.1f', {x})")
    return f"CASE WHEN {n} < 1024 THEN concat(CAST({n} AS STRING), ' B') WHEN {n} < 1048576 THEN concat({one(f'{n} / 1024.0')}, ' KB') ELSE concat({one(f'{n} / 1048576.0')}, ' MB') END"


def table_row(d, cells):
    """Cells (an array of strings) as one row of a Markdown table."""
    return f"concat('| ', {d.join(cells, ' | ')}, ' |')"
