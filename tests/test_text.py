import random

import duckdb
import pyarrow as pa
import pytest

from docloom.functions import rules as R
from docloom.functions.dialect import DUCK
from docloom.operators import textrules as T
from docloom.operators.normalize import normalized, with_normalized
from docloom.operators.text_markdown import dedupe_paragraphs, document_title, page_markdown, pages_markdown, reflow, without_title
from docloom.plans import sql


@pytest.mark.parametrize(
    ("line", "want"),
    [("- a", "a"), ("• b c", "b c"), ("-a", None), ("- ", None), ("▫  x", "x")],
)
def test_bullet(line, want):
    assert T.bullet(line) == want


def test_numbered_and_headings():
    assert T.numbered("1. first item") == "first item"
    assert T.numbered("1. Introduction") is None and T.heading("1. Introduction") == (2, "1. Introduction")
    assert T.numbered("12) abc") == "abc" and T.numbered("123. abc") is None
    assert T.heading("##Deep") == (2, "Deep") and T.heading("####### x") is None
    assert T.heading("Chapter one") == (1, "Chapter one") and T.heading("Overview") == (2, "Overview")
    assert T.heading("SAFETY FIRST") == (2, "SAFETY FIRST") and T.heading("SAFETY FIRST.") is None and T.heading("AB") is None
    assert T.heading("x" * 121) is None


def test_markers_toc_roster_subtitle():
    assert T.page_marker("(iv)") and T.page_marker("Page 12") and T.page_marker("page +5") and not T.page_marker("page 4294967296") and not T.page_marker("()")
    assert T.toc_entry("Results  12") == "Results (p. 12)" and T.toc_entry("1 Results  12") is None and T.toc_entry("a  12") is None
    assert T.roster_line("Ann Example") and not T.roster_line("Ann.") and T.subtitle("(a subtitle)") and not T.subtitle("(short")


def test_word_breaks():
    assert T.repair_word_breaks("Gar dening and pot tery for  all") == "Gardening and pottery for all"
    assert T.repair_word_breaks("PDF reader the end") == "PDF reader the end"
    assert T.repair_word_breaks("This is a clean note") == "This isaclean note"


def test_reflow():
    assert reflow("The first line\ncontinues here.\nNew one\n\nhyphen-\nated") == ["The first line continues here.", "New one", "hyphenated"]
    assert reflow("A line\n- item\n- other\r\nrest") == ["A line", "- item", "- other", "rest"]
    assert reflow("") == []


def test_page_markdown():
    text = "SAFETY FIRST\n\nBe careful.\n\n- one\n- two\n\n1. third\n\nAfter it.\n\nPanel\n\nAnn Example\n\nBob Example\n\nThe end.\n\nCarl Example"
    assert page_markdown(text, repair=False) == "## SAFETY FIRST\n\nBe careful.\n\n- one\n- two\n1. third\n\nAfter it.\n\n## Panel\n\n- Ann Example\n\n- Bob Example\n\nThe end.\n\nCarl Example"
    assert page_markdown("Page 2\n\n(iv)") == ""


def test_pages():
    assert pages_markdown(["", " "]) == ""
    assert pages_markdown(["First page text.", " ", "Third page."], repair=False) == "First page text.\n\n---\n\n<!-- Page 3 -->\n\nThird page."
    titled = pages_markdown(["A Study Of Small Things\nA Study Of Small Things\n\nBody text follows here."], repair=False)
    assert titled.startswith("# A Study Of Small Things\n\n") and titled.count("A Study Of Small Things") == 1
    assert document_title("short") is None
    assert without_title("The Title\n\nbody", "the title") == "body"


def test_dedupe_is_idempotent():
    rnd = random.Random(5)
    for _ in range(50):
        text = "\n\n".join(rnd.choice(["a", "b", " a ", "", "c"]) for _ in range(12))
        once = dedupe_paragraphs(text)
        assert dedupe_paragraphs(once) == once
        assert all(x != y for x, y in zip(once.split("\n\n"), once.split("\n\n")[1:], strict=False)) or not once


def test_normalized():
    assert normalized("a  \n\n\n\n b\u200b \n```x  \n  c  \n\n\nd\n ``` \n\n") == "a\n\nb\n```x\n  c  \n\n\nd\n ```\n"
    assert normalized("") == "\n" and normalized("\r\n x\r\n") == "\nx\n"


def test_normalized_equals_the_query(spark):
    """The rule in one worker against the windows of the query, on texts with fences, blank runs and hidden characters."""
    rnd = random.Random(4)
    parts = ["", " ", "```", " ```py ", "a\u200bb ", "  c", "\u00ad", "# d", "\t"]
    rows = [(i, "\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for i in range(300)]
    con = duckdb.connect()
    con.register("t", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    # the query makes its own texts from documents; here they are given as they are
    made = sql.SQL["normalize_document"](DUCK).replace(sql.messy(DUCK), "(SELECT doc_id, text FROM t)")
    assert "documents" not in made
    got = dict(con.execute(made).fetchall())
    assert all(got[i] == normalized(t) for i, t in rows if i in got) and len(got) > 250


def test_rows_without_a_key_are_normalized_by_themselves(spark):
    df = spark.createDataFrame([(None, "a \n b"), (None, "c"), (1, "x\n\n\ny"), (1, "z"), (2, None)], "k long, markdown string")
    assert sorted((r.markdown or "", r.body) for r in with_normalized(df).collect()) == [("", None), ("a \n b", "a\nb\n"), ("c", "c\n"), ("x\n\n\ny", "x\n\ny\n"), ("z", "z\n")]


def test_trimming_by_characters_equals_the_pattern(spark):
    """Both engines' trims, one by edge characters and one by a pattern, on every white-space character and on others like it."""
    edges = [*R.WS_CHARS, "​", "᠎", "\x1c", "x", "﻿", ""]
    texts = [a + b + "é x y" + b + a for a in edges for b in ("", " ", "　")] + ["", " \n\t", " "]
    con = duckdb.connect()
    con.register("t", pa.table({"x": texts}))
    for rule in (R.trim, R.rtrim):
        want = [r[0] for r in con.execute(f"SELECT {rule(DUCK, 'x')} FROM t").fetchall()]
        assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(R.column(rule, "x")).collect()] == want
    assert len(R.WS_CHARS) == 25
