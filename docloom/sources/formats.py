"""Readers of the file formats: bytes in, Markdown and a warning out. Failures carry an error code."""

from __future__ import annotations

import codecs
import csv
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from typing import NamedTuple
from xml.etree import ElementTree

from docloom.functions import rules as R
from docloom.operators.text_markdown import page_markdown, pages_markdown
from docloom.operators.textrules import SPACES, split_words

MAX_ENTRY, MAX_TEXT = 250 * 1024 * 1024, 50 * 1024 * 1024
_UNREADABLE = re.compile(R._readable_class())
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class Failure(Exception):
    """A file that can't be converted, with its error code."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


class Converted(NamedTuple):
    markdown: str
    warning: str | None = None


# ---- text and quality


def decode(data: bytes) -> str:
    """UTF-8, or what a byte order mark says; anything else fails."""
    try:
        for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
            if data.startswith(mark):
                return data[len(mark) :].decode(name)
        return data.decode()
    except UnicodeDecodeError as e:
        raise Failure("CONVERSION_FAILED") from e


def readable(text: str) -> str:
    if not text.strip(SPACES):
        raise Failure("NO_READABLE_TEXT")
    return text


def readable_ratio(text: str) -> float:
    part = text[: R.QUALITY_CHARS]
    return len(_UNREADABLE.sub("", part)) / len(part) if part else 0.0


def is_garbage(text: str) -> bool:
    part = text[: R.QUALITY_CHARS]
    if len(part.strip(SPACES).encode()) < 20:
        return False
    words = split_words(part)[: R.QUALITY_WORDS]
    letters = [len(re.sub("[^A-Za-z]", "", w)) for w in words]
    share = sum(n >= 2 and 2 * n >= len(w) for n, w in zip(letters, words, strict=True)) / len(words) if words else 0.0
    spaces = sum(c in SPACES for c in part) / len(part)
    return (readable_ratio(part) < R.GARBAGE_CHARS and share < R.GARBAGE_WORDS) or (len(part.encode()) > 80 and spaces < 0.03 and share < 0.2)


def gated(text: str, warnings: list[str]) -> Converted:
    """The gate of extracted text: blank and garbled fails, too long fails, doubtful gets a warning."""
    readable(text)
    if len(text.encode()) > MAX_TEXT:
        raise Failure("FILE_TOO_LARGE")
    if is_garbage(text):
        raise Failure("NO_READABLE_TEXT")
    if readable_ratio(text) < R.LOW_QUALITY:
        warnings = [*warnings, R.LOW_QUALITY_WARNING]
    return Converted(text, " ".join(warnings) or None)


def from_txt(data: bytes, **options) -> Converted:
    return Converted(page_markdown(readable(decode(data)), options.get("repair_word_breaks", True)))


def from_md(data: bytes, **_) -> Converted:
    return Converted(readable(decode(data)))


def from_csv(data: bytes, **options) -> Converted:
    """A table of all rows under the first; a row of another width fails the file. Cells stand as they are unless escape."""
    csv.field_size_limit(MAX_ENTRY)  # a cell may be as large as its file
    try:
        rows = [r for r in csv.reader(io.StringIO(decode(data), newline=""), strict=False) if r]
    except csv.Error as e:
        raise Failure("CONVERSION_FAILED") from e
    head = rows[0] if rows else []
    if any(len(r) != len(head) for r in rows):
        raise Failure("CONVERSION_FAILED")
    clean = (lambda c: c.replace("|", "\\|").replace("\n", " ")) if options.get("escape") else str
    line = lambda cells: f"| {' | '.join(map(clean, cells))} |"
    return Converted("\n".join([line(head), line(["---"] * len(head)), *map(line, rows[1:])]) + "\n")


# ---- HTML


def drop_blocks(html: str, tags: tuple[str, ...]) -> str:
    for tag in tags:
        html = re.sub(f"(?is)<{tag}.*?</{tag}>", "", html)
    return html


def _tidy(text: str) -> str:
    lines = [x.strip(SPACES) for x in text.split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip(SPACES)


def html_markdown(html: str) -> str:
    html = drop_blocks(html, R.STRIPPED_TAGS)
    for literal, by in R.CHAPTER_BREAKS:
        html = html.replace(literal, by)
    html = re.sub(r"(?i)<(?:[^>]*<)?\s*h([1-6])(?:[^a-z0-9<>][^<>]*)?>", lambda m: "\n\n" + "#" * int(m[1]) + " ", html)
    html = re.sub(r"(?i)<(?:[^>]*<)?\s*li(?:[^a-z0-9<>][^<>]*)?>", "- ", html)
    return _tidy(re.sub(r"<[^>]*$", "", re.sub("<[^>]*>", "", html)))


def kindle_markdown(text: str, title: str = "") -> str:
    if "<" in text and ">" in text:
        text = drop_blocks(text, R.KINDLE_TAGS)
        for literal, by in R.KINDLE_BREAKS:
            text = text.replace(literal, by)
        text = re.sub(r"<[^>]*$", "", re.sub("<[^>]*>", "", text))
    title = title.strip(SPACES)
    return (f"# {title}\n\n" if title and title.lower() != "unknown" else "") + _tidy(text)


# ---- zip based formats


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError) as e:
        raise Failure("CONVERSION_FAILED") from e


def _entry(archive: zipfile.ZipFile, name: str) -> str | None:
    """An entry's text; None if it is not there. Its declared and its real size are bounded."""
    try:
        info = archive.getinfo(name)
        if info.file_size > MAX_ENTRY:
            raise Failure("ZIP_BOMB_DETECTED")
        with archive.open(info) as f:
            held = f.read(MAX_ENTRY + 1)
    except KeyError:
        return None
    except (zipfile.BadZipFile, zlib.error, RuntimeError, OSError, EOFError) as e:
        raise Failure("CONVERSION_FAILED") from e
    if len(held) > MAX_ENTRY:
        raise Failure("ZIP_BOMB_DETECTED")
    return held.decode("utf-8", "replace")


def _xml(text: str) -> ElementTree.Element:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:  # no entity expansion from untrusted files
        text = re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text)
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise Failure("CONVERSION_FAILED") from e


def _run_text(run: ElementTree.Element) -> str:
    on = lambda tag: (x := run.find(f"{_WORD}rPr/{_WORD}{tag}")) is not None and x.get(f"{_WORD}val") not in ("0", "false")
    mark = "*" * (2 * on("b") + on("i"))
    return "".join(f"{mark}{t.text}{mark}" for t in run.iter(f"{_WORD}t") if t.text)


def _paragraph(p: ElementTree.Element) -> tuple[str, str]:
    """(style prefix, text)."""
    style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
    name = (style.get(f"{_WORD}val") or "") if style is not None else ""
    level = re.fullmatch("[Hh]eading ?([1-6])", name)
    prefix = "#" * int(level[1]) + " " if level else {"ListBullet": "- ", "ListNumber": "1. "}.get(name, "")
    return prefix, "".join(_run_text(r) for r in p.iter(f"{_WORD}r")).strip(SPACES)


def docx_markdown(xml: str) -> str:
    """Body paragraphs and tables in order. All paragraphs of a cell are kept, joined by spaces."""
    body = _xml(xml).find(f"{_WORD}body")
    out, before = [], ""
    for child in body if body is not None else ():
        if child.tag == f"{_WORD}p":
            prefix, text = _paragraph(child)
            if not text:
                continue
            item = prefix in ("- ", "1. ")
            out.append(("" if not out else "\n" if before == "item" else "\n\n") + prefix + text)
            before = "item" if item else "block"
        elif child.tag == f"{_WORD}tbl":
            rows = [[" ".join(t for p in c.iter(f"{_WORD}p") if (t := _paragraph(p)[1])) for c in r.findall(f"{_WORD}tc")] for r in child.findall(f"{_WORD}tr")]
            if rows:
                lines = [f"| {' | '.join(r)} |" for r in rows]
                lines.insert(1, f"| {' | '.join(['---'] * len(rows[0]))} |")
                out.append(("\n\n" if out else "") + "\n".join(lines))
                before = "block"
    return "".join(out)


def from_docx(data: bytes, **_) -> Converted:
    with _open(data) as archive:
        xml = _entry(archive, "word/document.xml")
    if xml is None:
        raise Failure("CONVERSION_FAILED")
    return Converted(readable(docx_markdown(xml)))


def href_path(base: str, href: str) -> str:
    href = href.partition("#")[0].replace("%20", " ").replace("%28", "(").replace("%29", ")").lstrip("/")
    return f"{base}/{href}" if base else href


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def epub_chapters(archive: zipfile.ZipFile) -> list[str | None]:
    """The chapters' HTML in the order of the spine (without one, of the manifest); None where one can't be read."""
    container = _entry(archive, "META-INF/container.xml")
    if container is None:
        raise Failure("CONVERSION_FAILED")
    root = next((e.get("full-path") for e in _xml(container).iter() if _local(e.tag) == "rootfile"), None)
    opf = _entry(archive, root.replace("\\", "/")) if root else None
    if opf is None:
        raise Failure("CONVERSION_FAILED")
    elements = list(_xml(opf).iter())
    manifest = {e.get("id"): e.get("href") or "" for e in elements if _local(e.tag) == "item"}
    spine = [e.get("idref") for e in elements if _local(e.tag) == "itemref"]
    base = posixpath.dirname(root.replace("\\", "/"))
    wanted = [manifest.get(i) for i in spine] if spine else list(manifest.values())
    out: list[str | None] = []
    for href in wanted:
        path = href_path(base, href) if href else ""
        if not spine and not re.search(r"\.(xhtml|html?|xml)$", path.lower()):
            continue
        try:
            out.append(_entry(archive, path) if re.search(r"\.(xhtml|html?|xml)$", path.lower()) else None)
        except Failure:
            out.append(None)
    return out


def from_epub(data: bytes, **_) -> Converted:
    with _open(data) as archive:
        chapters = epub_chapters(archive)
    made = [html_markdown(c) if c else "" for c in chapters]
    kept = [m for m in made if m]
    skipped = len(made) - len(kept)
    warnings = [f"{skipped} of {len(made)} chapters were skipped."] if skipped else []
    return gated("\n\n\n---\n\n".join(kept), warnings)


# ---- PDF


_PDF_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_PDF_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_TEXT = re.compile(rb"/[^\s/\[\]()<>{}%]+|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|T\*|[A-Za-z'\"]+", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes, font: CMap | None = None) -> str:
    if token.startswith(b"<"):
        raw = _hex(token)
        if font:
            return font.decode(raw)
        return raw[2:].decode("utf-16-be", "replace") if raw.startswith(codecs.BOM_UTF16_BE) else raw.decode("latin-1")

    def plain(m: re.Match) -> bytes:
        code = m[1]
        if code[:1].isdigit():
            return bytes([int(code, 8) & 255])
        return b"" if code in (b"\n", b"\r\n") else _PDF_ESCAPES.get(code, code)

    raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)
    return font.decode(raw) if font else raw.decode("latin-1")


class CMap:
    """What a font's codes stand for: code strings of given widths to text."""

    def __init__(self, source: bytes) -> None:
        self.text: dict[bytes, str] = {}
        self.widths = sorted({len(_hex(a)) for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", source, re.S) for a in re.findall(rb"<([^>]*)>", block)}) or [1]
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", source, re.S):
            for a, b in re.findall(rb"<([^>]*)>\s*<([^>]*)>", block):
                self.text[_hex(a)] = _hex(b).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", source, re.S):
            for a, b, to, each in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[(.*?)\])", block, re.S):
                low, high, width = int.from_bytes(_hex(a), "big"), int.from_bytes(_hex(b), "big"), len(_hex(a))
                texts = [_hex(x) for x in re.findall(rb"<([^>]*)>", each)]
                for i, code in enumerate(range(low, min(high, low + 0xFFFF) + 1)):
                    if texts:
                        made = texts[i] if i < len(texts) else None
                    else:  # the last 16 bits count up
                        made = _hex(to)[:-2] + ((int.from_bytes(_hex(to)[-2:], "big") + i) & 0xFFFF).to_bytes(2, "big")
                    if made is not None:
                        self.text[code.to_bytes(width, "big")] = made.decode("utf-16-be", "replace")

    def decode(self, raw: bytes) -> str:
        out, i = [], 0
        while i < len(raw):
            width = next((w for w in self.widths if raw[i : i + w] in self.text), self.widths[0])
            out.append(self.text.get(raw[i : i + width], ""))
            i += width
        return "".join(out)


def _hex(digits: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def pdf_content_text(content: bytes, fonts: dict[bytes, CMap] | None = None) -> str:
    """What a content stream's text operators show; moving to another line starts a new one."""
    out, stack, font = [], [], None
    for token in _PDF_TEXT.findall(content):
        if token == b"Tf":
            font = (fonts or {}).get(next((t for t in stack if t[:1] == b"/"), b""))
            stack = []
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            out += [_pdf_string(t, font) if t[:1] in b"(<" else " " if float(t) < -200 else "" for t in stack if t[:1] in b"(<" or (token == b"TJ" and re.fullmatch(rb"-?\d*\.?\d+", t))]
            stack = []
        elif token in (b"Td", b"TD"):
            out.append("\n" if len(stack) >= 2 and float(stack[-1] if re.fullmatch(rb"-?\d*\.?\d+", stack[-1]) else 0) else " ")
            stack = []
        elif token in (b"T*", b"ET"):
            out.append("\n")
            stack = []
        elif token[:1].isalpha():
            stack = []
        elif token not in (b"[", b"]"):
            stack.append(token)
    return re.sub("\n+", "\n", "".join(out)).strip()


def _inflated(data: bytes) -> bytes:
    """Flate-coded bytes, as far as they can be read; more than an entry may hold fails the file."""
    reader = zlib.decompressobj()
    try:
        out = reader.decompress(data, MAX_ENTRY)
    except zlib.error:
        return b""
    if reader.unconsumed_tail:
        raise Failure("ZIP_BOMB_DETECTED")
    return out


_REF = re.compile(rb"(\d+)\s+\d+\s+R")


class Pdf:
    """The objects of a PDF file, those in object streams, too."""

    def __init__(self, data: bytes) -> None:
        self.objects = {int(m[1]): m[2] for m in _PDF_OBJECT.finditer(data)}
        for number in [n for n, b in self.objects.items() if re.search(rb"/Type\s*/ObjStm\b", b)]:
            count, first = (re.search(rb"/%s\s+(\d+)" % key, self.objects[number]) for key in (b"N", b"First"))
            held = self.stream(number)
            if not (count and first and held):
                continue
            head = [int(x) for x in re.findall(rb"\d+", held[: int(first[1])])][: 2 * int(count[1])]
            at = [int(first[1]) + x for x in head[1::2]] + [len(held)]
            for i, n in enumerate(head[0::2]):
                if i + 1 < len(at):
                    self.objects.setdefault(n, held[at[i] : at[i + 1]])

    def stream(self, number: int) -> bytes:
        m = _PDF_STREAM.match(self.objects.get(number, b""))
        if not m:
            return b""
        return _inflated(m[2]) if b"FlateDecode" in m[1] else m[2]

    def pages(self, number: int, seen: set[int]) -> list[int]:
        kids = re.search(rb"/Kids\s*\[(.*?)\]", self.objects.get(number, b""), re.S)
        if not kids or number in seen:
            return [number]
        return [p for k in _REF.findall(kids[1]) for p in self.pages(int(k), seen | {number})]

    def _dictionary(self, body: bytes, key: bytes) -> bytes:
        """The dictionary under a key, given there or by reference."""
        m = re.search(rb"/%s\s*(?:(\d+)\s+\d+\s+R|(<<))" % key, body)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        depth, at = 0, m.start(2)
        for mark in re.finditer(rb"<<|>>", body[at:]):
            depth += 1 if mark[0] == b"<<" else -1
            if not depth:
                return body[at : at + mark.end()]
        return body[at:]

    def fonts(self, page: int) -> dict[bytes, CMap]:
        """The page's fonts that say what their codes stand for; a page without resources has its parent's."""
        body, seen = self.objects.get(page, b""), {page}
        while not (held := self._dictionary(body, b"Resources")):
            up = re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", body)
            if not up or int(up[1]) in seen:
                return {}
            seen.add(int(up[1]))
            body = self.objects.get(int(up[1]), b"")
        out = {}
        for name, number in re.findall(rb"(/[^\s/\[\]()<>{}%]+)\s+(\d+)\s+\d+\s+R", self._dictionary(held, b"Font")):
            to = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", self.objects.get(int(number), b""))
            if to:
                out[name] = CMap(self.stream(int(to[1])))
        return out


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page: plain and Flate-coded content, objects in object streams, fonts of one byte or with a ToUnicode map."""
    if not data.lstrip().startswith(b"%PDF"):
        raise Failure("CONVERSION_FAILED")
    if re.search(rb"/Encrypt\b", data):
        raise Failure("PASSWORD_PROTECTED")
    pdf = Pdf(data)
    root = next((n for n, b in pdf.objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)), None)
    order = pdf.pages(root, set()) if root is not None else [n for n, b in pdf.objects.items() if re.search(rb"/Type\s*/Page\b", b)]
    out = []
    for number in order:
        contents = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", pdf.objects.get(number, b""), re.S)
        refs = _REF.findall(contents[1] or contents[2]) if contents else []
        out.append(pdf_content_text(b"\n".join(pdf.stream(int(r)) for r in refs), pdf.fonts(number)))
    return out


def from_pdf(data: bytes, **options) -> Converted:
    pages = options.get("pdf_pages", pdf_pages)(data)
    return gated(readable(pages_markdown(pages, options.get("repair_word_breaks", True))), [])


# ---- Kindle


def palmdoc(data: bytes) -> bytes:
    """PalmDOC decompression: literals, runs, back-references, space and character pairs."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back = pair >> 3
            if not 0 < back <= len(out):
                raise Failure("CONVERSION_FAILED")
            for _ in range((pair & 7) + 3):
                out.append(out[-back])
    return bytes(out)


def _records(data: bytes) -> list[bytes]:
    if len(data) < 78:
        raise Failure("CONVERSION_FAILED")
    n = struct.unpack_from(">H", data, 76)[0]
    if not n or len(data) < 78 + 8 * n:
        raise Failure("CONVERSION_FAILED")
    at = [struct.unpack_from(">L", data, 78 + 8 * i)[0] for i in range(n)] + [len(data)]
    if any(a > b for a, b in zip(at, at[1:], strict=False)):
        raise Failure("CONVERSION_FAILED")
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _exth(record: bytes) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    if len(record) < 132 or not struct.unpack_from(">L", record, 128)[0] & 0x40:
        return out
    at = 16 + struct.unpack_from(">L", record, 20)[0]
    if record[at : at + 4] != b"EXTH":
        return out
    count, at = struct.unpack_from(">L", record, at + 8)[0], at + 12
    for _ in range(count):
        if at + 8 > len(record):
            break
        kind, size = struct.unpack_from(">LL", record, at)
        out.setdefault(kind, record[at + 8 : at + size])
        at += max(size, 8)
    return out


def kindle_book(data: bytes) -> tuple[str, str, dict[int, bytes]]:
    """(title, text, EXTH entries) of a Palm database holding a book without protection."""
    records = _records(data)
    head = records[0]
    if len(head) < 16:
        raise Failure("CONVERSION_FAILED")
    compression, _, length, count, _, encryption = struct.unpack_from(">HHLHHH", head, 0)
    exth = _exth(head)
    if encryption or any(any(exth.get(k, b"")) for k in (1, 2, 3)):
        raise Failure("PASSWORD_PROTECTED")
    if compression not in (1, 2):
        raise Failure("CONVERSION_FAILED")
    trailing = struct.unpack_from(">H", head, 242)[0] if len(head) >= 244 and head[16:20] == b"MOBI" else 0
    parts = []
    for record in records[1 : 1 + count]:
        for bit in range(15, 0, -1):
            if trailing >> bit & 1 and record:
                size = 0
                for b in record[-4:]:
                    size = (b & 0x7F) if b & 0x80 else size << 7 | (b & 0x7F)
                record = record[: len(record) - size] if 0 < size <= len(record) else record
        if trailing & 1 and record:
            record = record[: -((record[-1] & 3) + 1)]
        parts.append(palmdoc(record) if compression == 2 else record)
    raw = b"".join(parts)[: length or None]
    code = struct.unpack_from(">L", head, 28)[0] if head[16:20] == b"MOBI" and len(head) >= 32 else 1252
    title = exth.get(503, b"")
    if not title and head[16:20] == b"MOBI" and len(head) >= 92:
        at, size = struct.unpack_from(">LL", head, 84)
        title = head[at : at + size]
    name = "utf-8" if code == 65001 else "cp1252"
    return title.decode(name, "replace"), raw.decode(name, "replace"), exth


def from_kindle(data: bytes, **_) -> Converted:
    title, text, exth = kindle_book(data)
    offset = int.from_bytes(exth.get(121, b"")[:4], "big")
    if 0 < offset < len(data):
        try:
            inner = kindle_book(data[offset:])
            if inner[1].strip(SPACES):
                title, text = inner[0] or title, inner[1]
        except Failure:
            pass  # a newer section that can't be read: the older one stands
    return gated(kindle_markdown(readable(text), title), [])


CONVERTERS: dict[str, Callable[..., Converted]] = {
    "txt": from_txt, "md": from_md, "csv": from_csv, "docx": from_docx, "pdf": from_pdf, "epub": from_epub, "mobi": from_kindle, "azw3": from_kindle, "azw": from_kindle,
}


def convert(ext: str, data: bytes, seconds: int = 30, **options) -> tuple[str | None, str | None, str | None]:
    """(markdown, warning, error code) of one file; never raises. The time limit needs a process of its own signal."""
    import signal
    import threading

    timed = seconds > 0 and threading.current_thread() is threading.main_thread()

    def late(*_):
        raise Failure("TIMEOUT_EXCEEDED")

    before = signal.signal(signal.SIGALRM, late) if timed else None
    try:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, seconds)
        made = CONVERTERS[ext](data, **options)
        return made.markdown, made.warning, None
    except Failure as e:
        return None, None, e.code
    except KeyError:
        return None, None, "CONVERSION_FAILED" if ext in CONVERTERS else "UNSUPPORTED_FILE"
    except Exception:  # noqa: BLE001  one bad file must not end the batch
        return None, None, "CONVERSION_FAILED"
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
