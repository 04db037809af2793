import io
import struct
import zipfile
import zlib

import pytest

from docloom.sources import formats as X


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def code(call, *args):
    with pytest.raises(X.Failure) as e:
        call(*args)
    return e.value.code


def test_text():
    assert X.from_txt("﻿Été calme.".encode()).markdown == "Été calme."
    assert X.from_txt("OK then".encode("utf-16")).markdown == "OK then"
    assert code(X.from_txt, b"") == code(X.from_md, b" \n\t") == "NO_READABLE_TEXT"
    assert code(X.from_txt, b"\xff\xfe\xfa\xfb\x00") in ("CONVERSION_FAILED", "NO_READABLE_TEXT")
    assert code(X.from_txt, b"a\xff") == "CONVERSION_FAILED"
    assert X.from_md(b"# T\n\n- a").markdown == "# T\n\n- a"


def test_csv():
    assert X.from_csv(b"a,b\n1,2\n").markdown == "| a | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert X.from_csv(b'a,b\n"x, y",2\n\n3,4').markdown == "| a | b |\n| --- | --- |\n| x, y | 2 |\n| 3 | 4 |\n"
    assert X.from_csv(b"").markdown == "|  |\n|  |\n"
    assert code(X.from_csv, b"a,b\n1,2,3\n") == "CONVERSION_FAILED"
    assert X.from_csv(b"a\nx|y\n", escape=True).markdown == "| a |\n| --- |\n| x\\|y |\n"


WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None, run=""):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}<w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def test_docx():
    cell = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('1')}{cell('2 &amp; 3')}</w:tr></w:tbl>"
    body = paragraph("Title", "Heading1") + paragraph("Plain.") + paragraph("one", "ListBullet") + paragraph("two", "ListNumber") + table + paragraph("bold", run="<w:b/>") + paragraph("both", run='<w:b/><w:i/>') + paragraph("off", run='<w:b w:val="0"/>')
    made = X.from_docx(zipped({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>"})).markdown
    assert made == "# Title\n\nPlain.\n\n- one\n1. two\n\n| A | B |\n| --- | --- |\n| 1 | 2 & 3 |\n\n**bold**\n\n***both***\n\noff"
    assert code(X.from_docx, zipped({"word/document.xml": f"<w:document {WORD}><w:body/></w:document>"})) == "NO_READABLE_TEXT"
    assert code(X.from_docx, zipped({"other.xml": ""})) == code(X.from_docx, b"no zip") == "CONVERSION_FAILED"


def epub(chapters, spine):
    items = "".join(f'<item id="{k}" href="{k}.xhtml"/>' for k in chapters)
    refs = "".join(f'<itemref idref="{k}"/>' for k in spine)
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/content.opf"/></rootfiles></container>'
    return zipped({"META-INF/container.xml": container, "OPS/content.opf": opf} | {f"OPS/{k}.xhtml": v for k, v in chapters.items()})


def test_epub():
    book = epub({"a": "<h1>One</h1><p>First chapter of the book.</p>", "b": "<h2>Two</h2><ul><li>x</li><li>y</li></ul><script>no</script>"}, ["a", "b"])
    assert X.from_epub(book) == ("# One\n\nFirst chapter of the book.\n\n\n---\n\n## Two\n\n- x\n- y", None)
    made = X.from_epub(epub({"a": "<p>Only this chapter is there.</p>"}, ["a", "gone"]))
    assert made.warning == "1 of 2 chapters were skipped."
    assert code(X.from_epub, zipped({"x": ""})) == "CONVERSION_FAILED"


def pdf(content, flate=False, more=b""):
    data = zlib.compress(content) if flate else content
    filters = b"/Filter /FlateDecode " if flate else b""
    return b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R>> endobj\n4 0 obj <<" + filters + b"/Length %d>> stream\n" % len(data) + data + b"\nendstream endobj\n" + more


def test_pdf():
    content = b"BT /F1 12 Tf 72 700 Td (Sample page with a \\(note\\)) Tj 0 -20 Td [(second) -250 (line of it)] TJ ET"
    for flate in (False, True):
        assert X.pdf_pages(pdf(content, flate)) == ["Sample page with a (note)\nsecond line of it"]
    assert "Sample page" in X.from_pdf(pdf(content), repair_word_breaks=False).markdown
    assert code(X.from_pdf, b"not a pdf") == "CONVERSION_FAILED"
    assert code(X.from_pdf, pdf(b"")) == "NO_READABLE_TEXT"
    assert code(X.from_pdf, pdf(content, more=b"trailer <</Encrypt 9 0 R>>")) == "PASSWORD_PROTECTED"


def mobi(text, encryption=0, compression=1, title=b"A Book"):
    head = struct.pack(">HHLHHHH", compression, 0, len(text), 1, 4096, encryption, 0) + b"MOBI" + struct.pack(">LLL", 232, 2, 65001)
    head = head.ljust(84, b"\0") + struct.pack(">LL", 248, len(title))
    head = head.ljust(248, b"\0") + title
    records, at, table = [head, text], 78 + 16, b""
    for r in records:
        table += struct.pack(">LL", at, 0)
        at += len(r)
    return b"\0" * 76 + struct.pack(">H", 2) + table + b"".join(records)


def test_kindle():
    made = X.from_kindle(mobi(b"<p>Some readable words of a book.</p><p>More of it.</p>"))
    assert made.markdown == "# A Book\n\nSome readable words of a book.\n\nMore of it."
    assert code(X.from_kindle, mobi(b"x", encryption=2)) == "PASSWORD_PROTECTED"
    assert code(X.from_kindle, b"short") == "CONVERSION_FAILED"
    assert X.palmdoc(b"abc\x80\x1b" + bytes([0xC0 | ord("d")])) == b"abc" + b"abcabc" + b" d"


def test_gate():
    assert not X.is_garbage("An English sentence of ordinary words.") and X.is_garbage("ÀÁÂÃÄÅÆÇÈÉ" * 20)
    assert not X.is_garbage("ÀÁÂ")
    assert X.convert("xlsx", b"") == (None, None, "UNSUPPORTED_FILE")
    assert X.convert("md", b"# x") == ("# x", None, None)


def test_timeout(monkeypatch):
    def slow(data, **_):
        while True:
            pass

    monkeypatch.setitem(X.CONVERTERS, "txt", slow)
    assert X.convert("txt", b"x", seconds=1) == (None, None, "TIMEOUT_EXCEEDED")


def test_csv_cells_of_any_size():
    big = "x" * 200_000
    assert X.from_csv(f"a,b\n1,{big}\n".encode()).markdown == f"| a | b |\n| --- | --- |\n| 1 | {big} |\n"


def test_pdf_object_streams_and_unicode_maps():
    """Page tree and font in an object stream, codes of two bytes with a map, and of one byte without."""
    held = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [3 0 R] /Count 1 /Resources <</Font <</F1 6 0 R /F2 9 0 R>> >> >>"), (3, b"<</Type /Page /Parent 2 0 R /Contents 4 0 R>>"), (6, b"<</Type /Font /ToUnicode 7 0 R>>"), (9, b"<</Type /Font>>")]
    body, head = b"", b""
    for number, text in held:
        head += b"%d %d " % (number, len(body))
        body += text + b" "
    packed = zlib.compress(head + body)
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0005> <00480069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00E9> <4E2D>] endbfrange"
    content = zlib.compress(b"BT /F1 12 Tf <000500100011> Tj ( \\020\\000\\041) Tj T* /F2 9 Tf [(plain) -300 (text)] TJ ET")
    data = b"%%PDF-1.5\n5 0 obj <</Type /ObjStm /N 5 /First %d /Filter /FlateDecode>> stream\n" % len(head) + packed + b"\nendstream endobj\n"
    data += b"4 0 obj <</Filter /FlateDecode>> stream\n" + content + b"\nendstream endobj\n7 0 obj <<>> stream\n" + cmap + b"\nendstream endobj\n"
    assert X.pdf_pages(data) == ["Hiab中\nplain text"]
    more = data.replace(content, zlib.compress(b"BT /F1 12 Tf (\\000\\020\\000\\041) Tj ET"))
    assert X.pdf_pages(more) == ["a中"]
