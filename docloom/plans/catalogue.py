"""Queries over the driver's tables, one for each operator, and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions.dialect import DUCK, SPARK
from docloom.operators.normalize import with_text_body
from docloom.operators.ordinal import with_ordinal
from docloom.operators.text_markdown import with_pages_markdown, with_paragraphs, with_repaired, with_text_markdown
from docloom.plans import sql

TABLES = ("documents", "pages", "conversations", "labels", "nation")


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:  # the plan is resolved at once, so a later call may set the views anew
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(text)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _run(make(SPARK)) for name, make in sql.SQL.items()}
ORACLES: dict[str, str] = {name: make(DUCK) for name, make in sql.SQL.items()}


# ---- steps with a running state: Arrow operators, and a fold where the other engine can express it


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_break_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_repaired(_documents(spark, sf_dir).select("doc_id", "text"), keep=False).select("doc_id", "repaired")


def reflow_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.regexp_replace("text", "((?:[^ \n]+ ){8})", "$1\n").alias("text")
    return with_paragraphs(_documents(spark, sf_dir).select("doc_id", wrapped)).select("doc_id", F.posexplode("paragraphs").alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("long"))


def txt_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text_markdown(_documents(spark, sf_dir).select("doc_id", "text"), keep=False).select("doc_id", "markdown")


def pdf_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of a page each turn, through the quality gate."""
    pages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    docs = pages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p")).select("conv_id", F.transform("p", lambda x: x["text"]).alias("pages"))
    made = with_pages_markdown(docs).select("conv_id", "markdown")
    gated = made.withColumn("m", F.col("markdown"))
    gated.createOrReplaceTempView("pdf_markdown")
    return spark.sql(f"SELECT conv_id, CASE WHEN {R.garbage(SPARK)} THEN NULL ELSE markdown END AS markdown, {R.garbage(SPARK)} AS is_garbage FROM {R.measured(SPARK, 'pdf_markdown', 'm')} AS g")


def txt_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text file: converted, normalised, measured, named, and listed."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("file_seq"), F.concat("source", F.lit(" Report.txt")).alias("source_file"), "text")
    made = with_text_body(docs, keep=False)
    ext = R.column(R.extension, "source_file")
    # all that the list needs of a text is worked out before rows are exchanged
    rows = made.select("file_seq", "source_file", ext.alias("source_type"), R.column(R.quality_warning, "body").alias("warning"), F.octet_length("body").cast("long").alias("markdown_bytes"))
    named = F.concat(R.column(R.slug, "source_file"), F.lit("-"), ext)
    rows = with_ordinal(rows.withColumn("base", named), docs.select(named.alias("base"), "file_seq"), "base", "file_seq", "n")
    status = F.expr(R.status(SPARK, "CAST(NULL AS STRING)", "warning"))
    output = F.concat(F.lit("documents/"), F.expr(R.output_name(SPARK, "base", "n")))
    return rows.select("file_seq", "source_file", "source_type", status.alias("status"), "warning", output.alias("output_file"), "markdown_bytes")


QUERIES |= {f.__name__: f for f in (word_break_repair, reflow_paragraphs, txt_to_markdown, pdf_to_markdown, txt_manifest)}

_NORM = f"trim({DUCK.sub('text', R.WS + '+', ' ')})"
_LAST = "regexp_extract(acc, '(?:^| )([^ ]*)$', 1)"
ORACLES["word_break_repair"] = f"""
    SELECT doc_id, CASE WHEN n = '' THEN '' ELSE list_reduce(string_split(n, ' '), lambda acc, w:
        CASE WHEN regexp_matches(acc, '(?:^| )[A-Za-z]{{2,3}}$') AND NOT regexp_matches(acc, '(?:^| )[A-Z]+$') AND {_LAST} NOT IN {R.quoted(DUCK, R.STOP_WORDS)}
              AND regexp_matches(acc, '(?:^| )(?:[A-Z][A-Za-z]*|[a-z]+)$') AND regexp_matches(w, '^[a-z]') THEN acc || w ELSE acc || ' ' || w END) END AS repaired
    FROM (SELECT doc_id, {_NORM} AS n FROM documents)
"""
# Here the paragraphs follow from neighbouring lines alone: no fragment of these texts becomes a block by merging.
_FLAGGED = f"(SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM {sql._flags(DUCK)} AS f)"
_HYPHENS = "replace(string_agg(line, chr(1) ORDER BY pos), '-' || chr(1), '')"
ORACLES["reflow_paragraphs"] = f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS pos, paragraph
    FROM (SELECT doc_id, para, replace({_HYPHENS}, chr(1), ' ') AS paragraph FROM {_FLAGGED} AS n WHERE line <> '' GROUP BY doc_id, para)
"""
