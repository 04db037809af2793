"""The query catalogue: each entry renders to SQL for either engine from the shared rules."""

from __future__ import annotations

from docloom.functions import rules as R
from docloom.functions.dialect import Dialect

ROUTED_EXT = ("txt", "md", "csv", "pdf", "xlsx", "")


def long(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


# ---- inputs derived from the tables, so that every rule has something to do


def lines_of(d: Dialect, source: str, keys: str = "doc_id", text: str = "text") -> str:
    return f"(SELECT {keys}, pos, {R.trim(d, 'line')} AS line FROM {d.explode(source, keys, R.lines(d, text))} AS q)"


def listy(d):
    """Lines under list marks in turn."""
    mark = "CASE pos % 8 WHEN 0 THEN '- ' WHEN 1 THEN '• ' WHEN 2 THEN '1. ' WHEN 3 THEN '12) ' WHEN 4 THEN '123. ' WHEN 5 THEN '## ' WHEN 6 THEN 'section ' ELSE '' END"
    return f"(SELECT doc_id, pos, {R.trim(d, f'concat({mark}, CASE WHEN pos % 3 = 0 THEN lower(line) ELSE line END)')} AS line FROM {lines_of(d, 'documents')} AS q0)"


def _beside(d, made):
    """All lines as they are, and beside them made-up ones, under ids below zero."""
    return f"(SELECT doc_id, pos, line FROM {lines_of(d, 'documents')} AS q0 UNION ALL SELECT -1 - doc_id AS doc_id, pos, {made} AS line FROM {lines_of(d, 'documents')} AS q1)"


def toc_lines(d):
    return _beside(d, "CASE WHEN pos % 2 = 0 THEN concat(line, '  ', CAST(pos AS STRING)) ELSE concat(substring(line, 1, 40), '  ', CAST(pos AS STRING)) END")


def marker_lines(d):
    return _beside(d, "CASE pos % 5 WHEN 0 THEN '(iv)' WHEN 1 THEN 'Page 3' WHEN 2 THEN 'page +44444444444' WHEN 3 THEN '( XIV )' ELSE concat('page ', line) END")


def soft_wrapped(d):
    return f"(SELECT doc_id, {d.sub('text', '((?:[^ \\n]+ ){8})', '$1' + chr(10))} AS text FROM documents)"


def messy(d):
    """Blank runs, fences, invisible characters and trailing blanks."""
    x = f"replace(text, ',', concat(',', {d.lit(chr(0x200B))}))"
    x = f"CASE WHEN doc_id % 2 = 1 THEN replace({x}, {d.lit(chr(10))}, {d.lit('  ' + chr(10) * 4 + '  ')}) ELSE {x} END"
    x = f"CASE WHEN doc_id % 3 = 0 THEN concat(substring({x}, 1, 200), {d.lit(chr(10) + '```py  ' + chr(10) + '  a  ' + chr(10) * 3 + 'b' + chr(10) + ' ``` ' + chr(10))}, substring({x}, 201)) ELSE {x} END"
    return f"(SELECT doc_id, {x} AS text FROM documents)"


def stored(d):
    """Exported documents: frontmatter, on some a warning, then the body."""
    body = R.frontmatter(d, "concat(source, '.txt')", "'txt'", "'good'", "CASE WHEN doc_id % 3 = 0 THEN 'check the layout' END", "text")
    return f"(SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN text ELSE {body} END AS stored FROM documents)"


def mojibake(d):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
    odd = "".join(chr(0xC0 + i) for i in range(len(letters)))
    vowels = "aeiou "
    part = "".join(chr(0xC0 + i) for i in range(len(vowels)))
    return f"(SELECT doc_id, lang, CASE doc_id % 7 WHEN 0 THEN translate(text, {d.lit(letters)}, {d.lit(odd)}) WHEN 1 THEN translate(text, {d.lit(vowels)}, {d.lit(part)}) ELSE text END AS text FROM documents)"


def files(d):
    """One file a document, so many a job as one takes: a name that repeats, a size around the limit, an extension in turn."""
    ext = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {d.lit('.' + e if e else '')}" for i, e in enumerate(ROUTED_EXT)) + " END"
    return f"(SELECT doc_id AS file_seq, CAST(floor(doc_id / {R.MAX_FILES}.0) AS BIGINT) AS job, concat(source, ' Report_', CAST(doc_id % 3 AS STRING), {ext}) AS source_file, n_chars * 8192 AS bytes, text FROM documents)"


def checked(d):
    """Files with extension, error, warning and status."""
    inner = f"(SELECT *, {R.extension(d, 'source_file')} AS ext FROM {files(d)} AS f0)"
    error = f"coalesce({R.file_error(d, 'ext', 'bytes')}, CASE WHEN file_seq % 11 = 3 THEN 'NO_READABLE_TEXT' END)"
    warned = "CASE WHEN file_seq % 13 = 5 THEN 'two pages were skipped' END"
    inner = f"(SELECT *, {error} AS error_code FROM {inner} AS f1)"
    inner = f"(SELECT *, CASE WHEN error_code IS NULL THEN {warned} END AS warning FROM {inner} AS f2)"
    return f"(SELECT *, {R.status(d, 'error_code', 'warning')} AS status FROM {inner} AS f3)"


def named(d):
    """Checked files with the output names of those that are exported."""
    base = f"concat({R.slug(d, 'source_file')}, '-', ext)"
    n = f"row_number() OVER (PARTITION BY job, {base}, status IN ('good', 'partial') ORDER BY file_seq)"
    name = R.output_name(d, base, n)
    return f"(SELECT *, CASE WHEN status IN ('good', 'partial') THEN concat('documents/', {name}) END AS output_file FROM {checked(d)} AS f4)"


def spine(d):
    """Books of ten pages: spine rows, some without manifest entry, some that are no chapters."""
    book = "CAST(floor(page_id / 10.0) AS BIGINT)"
    href = "concat('text/ch%20', CAST(page_id AS STRING), CASE WHEN page_id % 11 = 0 THEN '.png' WHEN page_id % 4 = 1 THEN '.HTM#top' ELSE '.xhtml' END)"
    return f"(SELECT {book} AS book, page_id AS pos, CASE WHEN page_id % 9 = 0 THEN NULL ELSE {href} END AS href, html FROM pages)"


def chapters(d):
    md = R.html_markdown(d, "html")
    return f"(SELECT book, pos, CASE WHEN href IS NOT NULL AND {R.content_href(d, d.sub('href', '#.*$'))} THEN {md} ELSE '' END AS md FROM {spine(d)} AS s)"


# ---- queries


def readable_ratio(d):
    return f"SELECT doc_id, round({R.readable_ratio(d, 'text')}, 9) AS ratio FROM {mojibake(d)} AS m"


def word_like_ratio(d):
    return f"SELECT doc_id, round({R.word_like_ratio(d, 'text')}, 9) AS ratio FROM {mojibake(d)} AS m"


def garbage_gate(d):
    return f"SELECT doc_id, {R.garbage(d)} AS is_garbage FROM {R.measured(d, f'{mojibake(d)} AS m')} AS g"


def quality_warning(d):
    return f"SELECT doc_id, {R.quality_warning(d, 'text')} AS warning FROM {mojibake(d)} AS m"


def client_garbage(d):
    return f"SELECT doc_id, {R.client_garbage(d, 'text')} AS is_garbage FROM {mojibake(d)} AS m"


def quality_by_lang(d):
    return f"SELECT lang, count(*) AS docs, round(avg({R.readable_ratio(d, 'text')}), 6) AS mean_ratio FROM documents GROUP BY lang"


def quality_vs_labels(d):
    return f"SELECT l.quality, l.toxic, count(*) AS docs, round(avg({R.word_like_ratio(d, 'text')}), 6) AS mean_words FROM documents x JOIN labels l ON x.doc_id = l.doc_id GROUP BY l.quality, l.toxic"


def html_strip_blocks(d):
    return f"SELECT page_id, {R.strip_blocks(d, 'html')} AS html FROM pages"


def html_to_markdown(d):
    return f"SELECT page_id, {R.html_markdown(d, 'html')} AS markdown FROM pages"


def html_heading_outline(d):
    src = f"(SELECT page_id, {R.html_markdown(d, 'html')} AS md FROM pages)"
    hashes = d.get("line", "^(#{1,6}) ")
    return f"SELECT page_id, pos, {long(f'length({hashes})', 'level')}, {d.get('line', '^#{1,6} (.*)$')} AS title FROM {lines_of(d, f'{src} AS p', 'page_id', 'md')} AS q WHERE {hashes} <> ''"


def collapse_blank_lines(d):
    return f"SELECT doc_id, {R.collapse_blank_lines(d, 'text')} AS text FROM {messy(d)} AS m"


def kindle_strip_html(d):
    return f"SELECT page_id, {R.kindle_titled(d, 'title', R.kindle_text(d, 'html'))} AS markdown FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(replace(html, '<', ''), '>', '') ELSE html END AS html, CASE page_id % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN ' ' ELSE url END AS title FROM pages) AS p"


def content_href_filter(d):
    return f"SELECT book, pos, href FROM {spine(d)} AS s WHERE href IS NOT NULL AND {R.content_href(d, d.sub('href', '#.*$'))}"


def href_resolve(d):
    return f"SELECT book, pos, {R.href_path(d, 'base', 'href')} AS path FROM (SELECT *, CASE WHEN book % 2 = 0 THEN 'OPS' ELSE '' END AS base FROM {spine(d)} AS s) AS t WHERE href IS NOT NULL"


def chapter_assembly(d):
    kept = f"(SELECT * FROM {chapters(d)} AS c WHERE md <> '')"
    return f"SELECT book, {d.ordered('md', 'pos', chr(10) * 3 + '---' + chr(10) * 2)} AS markdown FROM {kept} AS k GROUP BY book"


def chapter_skip_warning(d):
    counts = f"(SELECT book, count(*) AS total, CAST(sum(CASE WHEN md = '' THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM {chapters(d)} AS c GROUP BY book)"
    return f"SELECT book, total - skipped AS converted, skipped, CASE WHEN skipped > 0 THEN concat(CAST(skipped AS STRING), ' of ', CAST(total AS STRING), ' chapters were skipped.') END AS warning, CASE WHEN skipped > 0 THEN 'partial' ELSE 'good' END AS status FROM {counts} AS n"


def spine_manifest_join(d):
    manifest = f"(SELECT book, pos AS id, href FROM {spine(d)} AS s0 WHERE href IS NOT NULL)"
    return f"SELECT s.book, s.pos, m.href, m.href IS NULL AS missing FROM {spine(d)} AS s LEFT JOIN {manifest} AS m ON s.book = m.book AND s.pos = m.id"


def _fenced(d):
    """Lines with what normalising needs: whether a line is a fence, lies inside one, and is blank."""
    body = f"(SELECT doc_id, replace(text, {d.lit(chr(13))}, '') AS text FROM {messy(d)} AS m)"
    raw = d.explode(f"{body} AS b", "doc_id", R.lines(d, "text"))
    clean = d.sub(R.rtrim(d, "line"), R.INVISIBLE)
    marked = f"(SELECT doc_id, pos, line, {clean} AS clean, {d.has(clean, f'^{R.WS}*```')} AS fence FROM {raw} AS r)"
    return f"(SELECT *, CAST(coalesce(sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) % 2 AS inside FROM {marked} AS k)"


def fence_parity(d):
    return f"SELECT doc_id, pos, fence, inside FROM {_fenced(d)} AS f WHERE fence OR inside = 1"


def _normal_lines(d):
    text = f"CASE WHEN fence AND inside = 1 THEN line WHEN fence THEN clean WHEN inside = 1 THEN line ELSE {R.trim(d, 'clean')} END"
    shown = f"(SELECT doc_id, pos, {text} AS line, (inside = 0 AND NOT fence AND {R.blank(d, 'clean')}) AS blank FROM {_fenced(d)} AS f)"
    return f"(SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY pos), false) AS after_blank FROM {shown} AS s)"


def normalize_lines(d):
    return f"SELECT doc_id, pos, line FROM {_normal_lines(d)} AS n WHERE NOT (blank AND after_blank)"


def normalize_document(d):
    # empty documents have no lines, and become one line feed
    joined = f"(SELECT doc_id, {d.ordered('line', 'pos', chr(10))} AS md FROM {_normal_lines(d)} AS n WHERE NOT (blank AND after_blank) GROUP BY doc_id)"
    return f"SELECT doc_id, concat({R.rtrim(d, 'md')}, {d.lit(chr(10))}) AS markdown FROM {joined} AS j"


def strip_frontmatter(d):
    return f"SELECT doc_id, {R.strip_frontmatter(d, 'stored')} AS body FROM {stored(d)} AS s"


def preview_body(d):
    return f"SELECT doc_id, {R.preview(d, 'stored')} AS body FROM {stored(d)} AS s"


def garbage_preview(d):
    body = f"(SELECT doc_id, {R.preview(d, 'text')} AS body FROM {mojibake(d)} AS m)"
    return f"SELECT doc_id, {R.garbage_preview(d, 'body')} AS body FROM {R.measured(d, f'{body} AS b', 'body')} AS g"


def frontmatter_inject(d):
    return f"SELECT file_seq, {R.frontmatter(d, 'source_file', 'ext', 'status', 'warning', 'text')} AS stored FROM {checked(d)} AS c"


def line_split(d):
    return f"SELECT doc_id, pos, line FROM {lines_of(d, 'documents')} AS q"


def page_markers(d):
    return f"SELECT doc_id, pos, line FROM {marker_lines(d)} AS q WHERE {R.page_marker(d, 'line')}"


def toc_entries(d):
    return f"SELECT doc_id, pos, {R.toc_entry(d, 'line')} AS entry FROM {toc_lines(d)} AS q WHERE {R.toc_entry(d, 'line')} IS NOT NULL"


def bullets(d):
    return f"SELECT doc_id, pos, {R.bullet(d, 'line')} AS item FROM {listy(d)} AS q WHERE {R.bullet(d, 'line')} IS NOT NULL"


def numbered_items(d):
    return f"SELECT doc_id, pos, {R.numbered(d, 'line')} AS item FROM {listy(d)} AS q WHERE {R.numbered(d, 'line')} IS NOT NULL"


def heading_numbers(d):
    return f"SELECT doc_id, pos, {R.section_number(d, 'line')} AS is_section, {R.heading_number(d, 'line')} AS is_heading FROM {listy(d)} AS q WHERE {d.has('line', '^[0-9]')}"


def headings(d):
    return f"SELECT doc_id, pos, {long(R.heading_level(d, 'line'), 'level')}, {R.heading_title(d, 'line')} AS title FROM {listy(d)} AS q WHERE {R.heading_level(d, 'line')} IS NOT NULL"


def all_caps(d):
    return f"SELECT doc_id, pos, line FROM {lines_of(d, 'documents')} AS q WHERE {R.all_caps(d, 'line')}"


def subtitles(d):
    made = "CASE WHEN pos % 3 = 0 THEN concat('(', substring(line, 1, 60), ')') ELSE concat('(', line, ')') END"
    return f"SELECT doc_id, pos, line FROM {_beside(d, made)} AS q WHERE {R.subtitle(d, 'line')}"


def _roster(d):
    """Lines under a roster heading up to the first that ends the section: the running state as windows."""
    line = f"CASE WHEN pos % 6 = 0 THEN 'Panel' WHEN pos % 6 = 4 THEN concat(line, '.') ELSE {d.sub('substring(line, 1, 30)', '[. ]+$')} END"
    marked = f"(SELECT doc_id, pos, line, lower({R.heading_title(d, 'line')}) IN {R.quoted(d, R.ROSTER_LABELS)} AS opens, {R.heading_level(d, 'line')} IS NOT NULL AS heading, {R.roster_line(d, 'line')} AS fits FROM {_beside(d, line)} AS q)"
    over = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    state = f"(SELECT *, max(CASE WHEN opens THEN pos END) {over} AS opened, max(CASE WHEN (heading AND NOT coalesce(opens, false)) OR (NOT heading AND NOT fits) THEN pos END) {over} AS closed FROM {marked} AS m)"
    return f"(SELECT * FROM {state} AS s WHERE NOT heading AND fits AND opened IS NOT NULL AND opened > coalesce(closed, -1))"


def roster_lines(d):
    return f"SELECT doc_id, pos, line FROM {_roster(d)} AS r"


def _flags(d):
    src = lines_of(d, f"{soft_wrapped(d)} AS w")
    window = "OVER (PARTITION BY doc_id ORDER BY pos)"
    before = f"(SELECT doc_id, pos, line, starts, coalesce(lag(line) {window}, '') AS prev, lag(starts) {window} AS prev_starts FROM {R.starts(d, f'{src} AS q')} AS s)"
    return f"(SELECT doc_id, pos, line, (prev <> '' AND line <> '' AND {R.merges(d, 'prev', 'line', 'prev_starts', 'starts')}) AS joins FROM {before} AS b)"


def merge_flags(d):
    return f"SELECT doc_id, pos, joins FROM {_flags(d)} AS f"


def paragraph_groups(d):
    numbered = f"(SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM {_flags(d)} AS f)"
    return f"SELECT doc_id, {long('para', 'para')}, {d.ordered('line', 'pos', ' ')} AS text FROM {numbered} AS n WHERE line <> '' GROUP BY doc_id, para"


def block_kinds(d):
    return f"SELECT doc_id, pos, kind FROM {R.blocks(d, f'{listy(d)} AS q')} AS k WHERE line <> ''"


def block_separators(d):
    """Lines as blocks, put together with the separators that the neighbouring kinds ask for."""
    kept = f"(SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {R.blocks(d, f'{listy(d)} AS q')} AS k WHERE line <> '' AND NOT marker)"
    items = "('bullet', 'numbered', 'toc')"
    sep = f"CASE WHEN before IS NULL THEN '' WHEN before IN {items} AND kind IN {items} THEN {d.lit(chr(10))} ELSE {d.lit(chr(10) * 2)} END"
    pieces = f"(SELECT doc_id, pos, concat({sep}, {R.block_markdown(d)}) AS piece FROM {kept} AS b)"
    return f"SELECT doc_id, {d.ordered('piece', 'pos', '')} AS markdown FROM {pieces} AS p GROUP BY doc_id"


def title_case_ratio(d):
    return f"SELECT doc_id, pos, round({R.title_case_ratio(d, 'line')}, 9) AS ratio FROM {lines_of(d, 'documents')} AS q"


def _titled(d):
    title = f"trim({d.sub('substring(text, 1, 60)', '[.\\n]+', ' ')})"
    return f"(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat({title}, {d.lit(chr(10))}, {title}, {d.lit(chr(10) * 2)}, text) ELSE text END AS text FROM documents)"


def _with_title(d):
    lines = f"(SELECT doc_id, text, {R.title_lines(d, 'text')} AS ls FROM {_titled(d)} AS t0)"
    first = "coalesce(try_element_at(ls, 1), '')" if d.name == "spark" else "coalesce(ls[1], '')"
    first = f"(SELECT *, {first} AS first_line FROM {lines} AS t1)"
    again = d.size(d.keep("ls", "l", "lower(l) = lower(first_line) OR contains(l, first_line)"))
    counted = f"(SELECT *, {again} AS again, {R.title_case_ratio(d, 'first_line')} AS titled FROM {first} AS t2)"
    fits = f"{d.bytes('first_line')} BETWEEN 12 AND 120 AND NOT {d.has('first_line', '[.]$')} AND (again >= 2 OR ({d.size('ls')} <= 4 AND titled > 0.5))"
    return f"(SELECT doc_id, text, first_line AS title FROM {counted} AS t3 WHERE {fits})"


def document_title(d):
    return f"SELECT doc_id, title FROM {_with_title(d)} AS t"


def strip_title_blocks(d):
    body = f"replace(text, {d.lit(chr(10))}, {d.lit(chr(10) * 2)})"
    return f"SELECT doc_id, {R.strip_title_blocks(d, body, 'title')} AS body FROM {_with_title(d)} AS t"


def _repeated(d):
    """Blocks, every fourth given twice."""
    block = d.explode("documents", "doc_id", R.lines(d, "text"), "block")
    twice = f"(SELECT doc_id, pos * 2 AS pos, {R.trim(d, 'block')} AS block FROM {block} AS b UNION ALL SELECT doc_id, pos * 2 + 1 AS pos, {R.trim(d, 'block')} AS block FROM {block} AS b2 WHERE pos % 4 = 0)"
    return f"(SELECT * FROM {twice} AS t WHERE block <> '')"


def dedupe_paragraphs(d):
    marked = f"(SELECT *, lag(block) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {_repeated(d)} AS r)"
    return f"SELECT doc_id, {d.ordered('block', 'pos', chr(10) * 2)} AS markdown FROM {marked} AS m WHERE before IS NULL OR before <> block GROUP BY doc_id"


def pdf_pages_join(d):
    pages = f"(SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN ' ' ELSE {R.trim(d, 'text')} END AS md FROM conversations)"
    kept = f"(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {pages} AS p WHERE {d.has('md', R.NOT_WS)})"
    head = f"CASE WHEN n > 1 THEN concat({d.lit(chr(10) * 2 + '---' + chr(10) * 2 + '<!-- Page ')}, CAST(turn + 1 AS STRING), {d.lit(' -->' + chr(10) * 2)}) ELSE '' END"
    pieces = f"(SELECT conv_id, n, concat({head}, md) AS piece FROM {kept} AS k)"
    return f"SELECT conv_id, {d.ordered('piece', 'n', '')} AS markdown FROM {pieces} AS q GROUP BY conv_id"


def csv_markdown_table(d):
    cells = lambda *c: ("array(" if d.name == "spark" else "list_value(") + ", ".join(c) + ")"
    rows = (
        f"(SELECT -2 AS o, {R.table_row(d, cells(*[d.lit(c) for c in ('n_nationkey', 'n_name', 'n_regionkey')]))} AS line UNION ALL SELECT -1, {R.table_row(d, cells(*[d.lit('---')] * 3))} "
        f"UNION ALL SELECT CAST(n_nationkey AS INT), {R.table_row(d, cells('CAST(n_nationkey AS STRING)', 'n_name', 'CAST(n_regionkey AS STRING)'))} FROM nation)"
    )
    return f"SELECT 'nation' AS name, {d.ordered('line', 'o', chr(10))} AS markdown FROM {rows} AS r"


def ext_route(d):
    return f"SELECT file_seq, {R.extension(d, 'source_file')} AS ext, {R.extension(d, 'source_file')} IN {R.quoted(d, R.EXTENSIONS)} AS supported FROM {files(d)} AS f"


def hidden_files(d):
    return f"SELECT file_seq, path FROM (SELECT file_seq, concat('in/', CASE file_seq % 4 WHEN 0 THEN '.' WHEN 1 THEN '.d/' WHEN 2 THEN '_' ELSE '' END, source_file) AS path FROM {files(d)} AS f) AS g WHERE NOT {R.hidden(d, 'path')}"


def size_limit(d):
    return f"SELECT file_seq, {long('bytes', 'bytes')} FROM {files(d)} AS f WHERE bytes > least({20 * 1024 * 1024}, {R.MAX_FILE_BYTES})"


def batch_limit(d):
    return f"SELECT job, count(*) AS files, count(*) > {R.MAX_FILES - 1} AS rejected FROM {files(d)} AS f GROUP BY job"


def validate_files(d):
    return f"SELECT file_seq, error_code FROM {checked(d)} AS c"


def status_assign(d):
    return f"SELECT file_seq, status, warning FROM {checked(d)} AS c"


def sanitize_name(d):
    return f"SELECT file_seq, {R.sanitized(d, 'source_file')} AS name FROM (SELECT file_seq, concat('up/', source_file, ' é?') AS source_file FROM {files(d)} AS f0) AS f"


def slug_name(d):
    return f"SELECT file_seq, {R.slug(d, 'source_file')} AS slug FROM {files(d)} AS f"


def output_name_dedupe(d):
    return f"SELECT file_seq, output_file FROM {named(d)} AS n WHERE output_file IS NOT NULL"


def error_messages(d):
    codes = " UNION ALL ".join(f"SELECT {d.lit(k)} AS error_code, {d.lit(v)} AS message" for k, v in R.MESSAGES.items())
    return f"SELECT c.file_seq, c.error_code, m.message FROM {checked(d)} AS c JOIN ({codes}) AS m ON c.error_code = m.error_code"


def user_messages(d):
    return f"SELECT file_seq, {R.message(d, 'error_code', 'warning')} AS user_message FROM {checked(d)} AS c"


def _summary(d, source):
    n = lambda s: f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT)"
    return f"(SELECT job, count(*) AS total_files, {n('good')} AS converted, {n('partial')} AS partial, {n('failed')} AS failed, {n('unsupported')} AS unsupported FROM {source} GROUP BY job)"


def job_summary(d):
    return f"SELECT * FROM {_summary(d, f'{checked(d)} AS c')} AS s"


def job_status(d):
    return f"SELECT job, {R.job_status(d, 'total_files', 'partial', 'failed')} AS status FROM {_summary(d, f'{checked(d)} AS c')} AS n"


def exit_code(d):
    return f"SELECT job, {long(R.exit_code(d, 'status'), 'exit_code')} FROM ({job_status(d)}) AS j"


def index_md(d):
    line = "concat('- [', source_file, '](', output_file, ')')"
    return f"SELECT job, concat({d.lit('# Export Index' + chr(10) * 2)}, {d.ordered(line, 'file_seq', chr(10))}, {d.lit(chr(10))}) AS markdown FROM {named(d)} AS n WHERE output_file IS NOT NULL GROUP BY job"


def conversion_report(d):
    shown = "concat(upper(substring(status, 1, 1)), substring(status, 2))"
    error = "CASE WHEN error_code IS NULL THEN '—' ELSE error_code END"
    line = f"concat('| ', source_file, ' | ', {shown}, ' | ', {error}, ' | ', coalesce({R.message(d, 'error_code', 'warning')}, '—'), ' |')"
    head = "# Conversion Report\n\n| File | Status | Error | Message |\n|------|--------|-------|--------|\n"
    return f"SELECT job, concat({d.lit(head)}, {d.ordered(line, 'file_seq', chr(10))}, {d.lit(chr(10))}) AS markdown FROM {named(d)} AS n GROUP BY job"


def manifest_rows(d):
    return f"SELECT file_seq, error_code, {long(d.bytes('text'), 'markdown_bytes')}, output_file, source_file, ext AS source_type, status, {R.message(d, 'error_code', 'warning')} AS user_message, warning FROM {named(d)} AS n"


def _json(d, pairs):
    if d.name == "spark":
        return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + "), map('ignoreNullFields', 'false'))"
    return "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ") AS VARCHAR)"


def manifest_json(d):
    return f"SELECT file_seq, {_json(d, [(c, c) for c in ('error_code', 'markdown_bytes', 'output_file', 'source_file', 'source_type', 'status', 'user_message', 'warning')])} AS entry FROM ({manifest_rows(d)}) AS r"


def job_result_json(d):
    s = _summary(d, f"{checked(d)} AS c")
    job = R.job_status(d, "total_files", "partial", "failed")
    return f"SELECT job, {_json(d, [('status', job), ('exit_code', R.exit_code(d, f'({job})')), *((c, c) for c in ('total_files', 'converted', 'partial', 'failed', 'unsupported'))])} AS result FROM {s} AS s"


def input_label(d):
    return f"SELECT job, {d.ordered('source_file', 'file_seq', ', ')} AS label FROM {checked(d)} AS c GROUP BY job"


def before_after_metric(d):
    body = d.sub("stored", "(?s)^---\\n.*?\\n---\\n", "")
    return f"SELECT doc_id, {long(d.bytes('stored'), 'export_bytes')}, {long(d.bytes(body), 'body_bytes')} FROM {stored(d)} AS s"


def size_labels(d):
    return f"SELECT file_seq, {R.size_label(d, 'bytes')} AS label FROM {files(d)} AS f"


def client_validation(d):
    return f"SELECT file_seq, CASE WHEN bytes = 0 THEN 'empty' WHEN bytes > {R.MAX_FILE_BYTES} THEN 'too large' END AS problem FROM (SELECT file_seq, CASE WHEN file_seq % 10 = 0 THEN 0 ELSE bytes END AS bytes FROM {files(d)} AS f0) AS f"


def progress_percent(d):
    return f"SELECT file_seq, {long('round(100.0 * row_number() OVER (PARTITION BY job ORDER BY file_seq) / count(*) OVER (PARTITION BY job))', 'percent')} FROM {files(d)} AS f"


def big_endian_offset(d):
    value = "conv(hexed, 16, 10)" if d.name == "spark" else "CAST(concat('0x', hexed) AS UBIGINT)"
    return f"SELECT doc_id, CASE WHEN o = 0 OR o >= n_chars * 1000 THEN -1 ELSE o END AS section_offset FROM (SELECT doc_id, n_chars, CAST({value} AS BIGINT) AS o FROM (SELECT doc_id, n_chars, substring(md5(text), 1, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 8 END) AS hexed FROM documents) AS h) AS v"


#: Every function above that is a query.
SQL = {
    f.__name__: f
    for f in (
        readable_ratio, word_like_ratio, garbage_gate, quality_warning, client_garbage, quality_by_lang, quality_vs_labels, html_strip_blocks, html_to_markdown, html_heading_outline, collapse_blank_lines,
        kindle_strip_html, content_href_filter, href_resolve, chapter_assembly, chapter_skip_warning, spine_manifest_join, fence_parity, normalize_lines, normalize_document, strip_frontmatter, preview_body,
        garbage_preview, frontmatter_inject, line_split, page_markers, toc_entries, bullets, numbered_items, heading_numbers, headings, all_caps, subtitles, roster_lines, merge_flags, paragraph_groups,
        block_kinds, block_separators, title_case_ratio, document_title, strip_title_blocks, dedupe_paragraphs, pdf_pages_join, csv_markdown_table, ext_route, hidden_files, size_limit, batch_limit,
        validate_files, status_assign, sanitize_name, slug_name, output_name_dedupe, error_messages, user_messages, job_summary, job_status, exit_code, index_md, conversion_report, manifest_rows,
        manifest_json, job_result_json, input_label, before_after_metric, size_labels, client_validation, progress_percent, big_endian_offset,
    )
}
