"""A conversion job: files in, an export folder and archive out, with index, report, manifest and summary."""

from __future__ import annotations

import json
import os
import shutil
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions.dialect import SPARK
from docloom.operators.normalize import with_normalized
from docloom.sources.files import convert_files, list_files, read_files

GUIDE = "# Export\n\n- `documents/`: one Markdown file for each converted input\n- `data/`: CSV inputs as they came\n- `index.md`: links to the documents\n- `conversion-report.md`: how each input fared\n- `manifest.json`: the same for programs\n"


@dataclass(frozen=True)
class Options:
    max_files: int = R.MAX_FILES
    max_file_size_bytes: int = R.MAX_FILE_BYTES
    recursive: bool = False
    zip_name: str | None = None
    converted_by: str = "docloom"
    timeout_seconds: int = 30
    repair_word_breaks: bool = True
    escape_tables: bool = False
    #: All files unsupported counts as failure.
    strict_exit: bool = False
    extra: dict = field(default_factory=dict)


class Rejected(Exception):
    """The job was refused before any work; exit code 3."""

    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{R.MESSAGES[code]} {detail}".strip())
        self.code, self.exit_code = code, 3


def converted(spark: SparkSession, listing: list, options: Options) -> DataFrame:
    """One row a file: names, status, messages, body (normalised), stored text and raw bytes."""
    made = convert_files(read_files(spark, listing, options.max_file_size_bytes), options.timeout_seconds, repair_word_breaks=options.repair_word_breaks, escape=options.escape_tables, **options.extra)
    rows = with_normalized(made)
    rows = rows.withColumn("status", R.column(R.status, "error_code", "warning"))
    rows = rows.withColumn("user_message", R.column(R.message, "error_code", "warning"))
    exported = F.col("status").isin("good", "partial")
    base = F.concat(R.column(R.slug, "source_file"), F.lit("-"), F.col("source_type"))
    rows = rows.withColumns({"base": base, "exported": exported})
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("base", "exported").orderBy("file_seq")))
    rows = rows.withColumn("name", F.when(F.col("exported"), F.expr(R.output_name(SPARK, "base", "n"))))
    rows = rows.withColumn("output_file", F.concat(F.lit("documents/"), F.col("name")))
    stored = R.frontmatter(SPARK, "source_file", "source_type", "status", "warning", "body", options.converted_by)
    return rows.withColumn("stored", F.when(F.col("exported"), F.expr(stored))).drop("base", "n")


def summary(rows: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias("converted" if s == "good" else s)
    return rows.agg(F.count("*").alias("total_files"), *map(count, ("good", "partial", "failed", "unsupported")))


def _write(folder: str, name: str, data: bytes) -> None:
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _archive(folder: str, path: str) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                full = os.path.join(top, name)
                z.write(full, os.path.relpath(full, folder))


def index_text(files: list) -> str:
    return "# Export Index\n\n" + "".join(f"- [{r.source_file}]({r.output_file})\n" for r in files if r.output_file)


def report_text(files: list) -> str:
    lines = [f"| {r.source_file} | {r.status.title()} | {r.error_code or '—'} | {r.user_message or '—'} |\n" for r in files]
    return "# Conversion Report\n\n| File | Status | Error | Message |\n|------|--------|-------|--------|\n" + "".join(lines)


def manifest_text(files: list, converted_by: str) -> str:
    keys = ("error_code", "markdown_bytes", "output_file", "source_file", "source_type", "status", "user_message", "warning")
    entries = [{k: r[k] for k in keys} for r in files]
    return json.dumps({"files": entries, "generated_by": converted_by, "version": "1.0"}, indent=2, ensure_ascii=False)


def run_job(spark: SparkSession, inputs: list[str], output: str, options: Options | None = None, progress: Callable[[int, int, str | None], None] | None = None) -> dict:
    """Convert inputs into the folder output and an archive beside it; the job's result as a dict."""
    options = options or Options()
    if os.path.exists(output):
        raise Rejected("OUTPUT_ALREADY_EXISTS", output)
    listing = list_files(inputs, options.recursive)
    if not listing:
        raise Rejected("VALIDATION_ERROR", "No input files.")
    if len(listing) > options.max_files:
        raise Rejected("VALIDATION_ERROR", f"{len(listing)} files exceed the limit of {options.max_files}.")
    if progress:
        progress(0, len(listing), None)
    rows = converted(spark, listing, options).persist()  # conversion is costly and several results come from it
    try:
        return _export(rows, inputs, output, options, len(listing), progress)
    finally:
        rows.unpersist()


def _export(rows: DataFrame, inputs: list[str], output: str, options: Options, n_files: int, progress: Callable[[int, int, str | None], None] | None) -> dict:
    shown = rows.select("file_seq", "source_file", "source_type", "status", "output_file", "error_code", "warning", "user_message", F.coalesce(F.octet_length("body"), F.lit(0)).alias("markdown_bytes"))
    files = shown.orderBy("file_seq").collect()  # metadata only, at most max_files rows
    counts = summary(rows).first().asDict()
    os.makedirs(os.path.join(output, "documents"))
    done = 0
    for r in rows.where("exported").select("name", "stored", "raw_data", "source_file").toLocalIterator():
        _write(output, f"documents/{r['name']}", r.stored.encode())
        if r.raw_data is not None:
            _write(output, f"data/{r['name'].removesuffix('.md')}.csv", bytes(r.raw_data))
        done += 1
        if progress:
            progress(done, n_files, r.source_file)
    _write(output, "README.md", GUIDE.encode())
    _write(output, "index.md", index_text(files).encode())
    _write(output, "conversion-report.md", report_text(files).encode())
    _write(output, "manifest.json", manifest_text(files, options.converted_by).encode())
    zip_path = os.path.join(os.path.dirname(os.path.abspath(output)), options.zip_name or os.path.splitext(os.path.basename(os.path.abspath(output)))[0] + ".zip")
    _archive(output, zip_path)
    total, failed, partial = counts["total_files"], counts["failed"], counts["partial"]
    if options.strict_exit:
        failed += counts["unsupported"]
    status = "failed" if total and failed == total else "partial_success" if failed or partial else "success"
    names = ("source_file", "source_type", "status", "output_file", "error_code", "warning")
    listed = [{k: r[k] for k in names} | ({"user_message": r.user_message} if r.user_message is not None else {}) for r in files]
    return {"status": status, "exit_code": {"success": 0, "partial_success": 1, "failed": 2}[status], "input": ", ".join(inputs), "output_folder": output, "export_zip": zip_path, "summary": counts, "files": listed}


def remove_job(output: str) -> None:
    """Drop an export; fine if it isn't there."""
    shutil.rmtree(output, ignore_errors=True)


def export_table(rows: DataFrame, path: str) -> None:
    """The export as a table, for batches beyond one folder: written by the executors, nothing collected."""
    rows.drop("content").write.mode("errorifexists").parquet(path)


def preview(stored: DataFrame, name: str) -> DataFrame:
    """output_file, body of one stored document, looked up by its key (paths are never joined)."""
    body = f"(SELECT output_file, {R.preview(SPARK, 'stored')} AS body FROM stored_documents)"
    stored.where(F.col("output_file") == name).createOrReplaceTempView("stored_documents")
    return stored.sparkSession.sql(f"SELECT output_file, {R.garbage_preview(SPARK, 'body')} AS body FROM {R.measured(SPARK, body, 'body')} AS g")
