import json
import os
import zipfile

import pytest

from docloom.plans.job import Options, Rejected, preview, run_job
from docloom.sources.files import list_files


@pytest.fixture
def inputs(tmp_path):
    top = tmp_path / "in"
    (top / "sub").mkdir(parents=True)
    files = {
        "My Note.txt": b"A note.\n\n- one\n- two\n", "my_note.txt": b"Another note.", "table.csv": b"a,b\n1,2\n", "bad.csv": b"a,b\n1\n", "empty.txt": b"",
        "policy.md": b"# Policy\n\n\n\n\nText   \n", "data.xlsx": b"zz", ".hidden.txt": b"no", "_under.md": b"# U", "sub/deep.md": b"# Deep",
    }
    for name, data in files.items():
        (top / name).write_bytes(data)
    return top


def test_listing(inputs):
    names = [n for _, _, n, _ in list_files([str(inputs)])]
    assert names == sorted(n for n in os.listdir(inputs) if n != "sub" and not n.startswith("."))
    assert "deep.md" in [n for _, _, n, _ in list_files([str(inputs)], recursive=True)]
    assert list_files([str(inputs / "missing"), str(inputs / ".hidden.txt")]) == []


def test_job(spark, inputs, tmp_path):
    out, seen = tmp_path / "out", []
    result = run_job(spark, [str(inputs)], str(out), Options(zip_name="all.zip"), lambda *x: seen.append(x))
    assert result["status"] == "partial_success" and result["exit_code"] == 1
    assert result["summary"] == {"total_files": 8, "converted": 5, "partial": 0, "failed": 2, "unsupported": 1}
    by = {f["source_file"]: f for f in result["files"]}
    assert by["My Note.txt"]["output_file"] == "documents/my-note-txt.md" and by["my_note.txt"]["output_file"] == "documents/my-note-txt-2.md"
    assert by["bad.csv"]["error_code"] == "CONVERSION_FAILED" and by["empty.txt"]["error_code"] == "NO_READABLE_TEXT" and by["data.xlsx"]["status"] == "unsupported"
    assert "user_message" not in by["policy.md"]
    text = (out / "documents/policy-md.md").read_text()
    assert text == "---\nsource_file: policy.md\nsource_type: md\nconverted_by: docloom\nstatus: good\n---\n\n# Policy\n\nText\n"
    assert (out / "documents/my-note-txt.md").read_text().endswith("A note.\n\n- one\n- two\n")
    assert (out / "data/table-csv.csv").read_bytes() == b"a,b\n1,2\n"
    manifest = json.loads((out / "manifest.json").read_text())
    assert len(manifest["files"]) == 8 and {f["source_file"]: f["markdown_bytes"] for f in manifest["files"]}["policy.md"] == len("# Policy\n\nText\n")
    assert "| data.xlsx | Unsupported | UNSUPPORTED_FILE |" in (out / "conversion-report.md").read_text()
    assert "- [policy.md](documents/policy-md.md)" in (out / "index.md").read_text()
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert "documents/policy-md.md" in z.namelist() and "manifest.json" in z.namelist()
    assert seen[0][:2] == (0, 8)
    with pytest.raises(Rejected):
        run_job(spark, [str(inputs)], str(out))
    stored = spark.createDataFrame([("documents/policy-md.md", text)], "output_file string, stored string")
    assert preview(stored, "documents/policy-md.md").first().body == "# Policy\n\nText"


def test_refusals(spark, inputs, tmp_path):
    with pytest.raises(Rejected):
        run_job(spark, [str(tmp_path / "none")], str(tmp_path / "o"))
    with pytest.raises(Rejected):
        run_job(spark, [str(inputs)], str(tmp_path / "o"), Options(max_files=2))
    assert not (tmp_path / "o").exists()


def test_all_unsupported(spark, inputs, tmp_path):
    files = [str(inputs / "data.xlsx")]
    assert run_job(spark, files, str(tmp_path / "a"))["exit_code"] == 0
    assert run_job(spark, files, str(tmp_path / "b"), Options(strict_exit=True))["exit_code"] == 2


def test_size_limit(spark, inputs, tmp_path):
    got = run_job(spark, [str(inputs / "policy.md")], str(tmp_path / "c"), Options(max_file_size_bytes=3))
    assert got["files"][0]["error_code"] == "FILE_TOO_LARGE" and got["exit_code"] == 2


def test_stream(spark, inputs, tmp_path):
    from docloom.streaming.landing import convert_stream

    query = convert_stream(spark, str(inputs), str(tmp_path / "table"), str(tmp_path / "check"))
    query.awaitTermination(120)
    rows = {r.source_file: r for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert rows["policy.md"].status == "good" and rows["bad.csv"].status == "failed" and "data.xlsx" not in rows and "empty.txt" not in rows


def test_a_file_whose_size_cannot_be_told_fails_alone(spark, tmp_path, monkeypatch):
    from docloom.sources import files

    (tmp_path / "in").mkdir()
    for name in ("good.txt", "odd.txt"):
        (tmp_path / "in" / name).write_text("Some words that can be read.")
    plain = os.path.getsize

    def size(path):
        if str(path).endswith("odd.txt"):
            raise OSError("gone")
        return plain(path)

    monkeypatch.setattr(files.os.path, "getsize", size)
    listing = files.list_files([str(tmp_path / "in")])
    monkeypatch.undo()
    rows = {r.source_file: r.error_code for r in files.convert_files(files.read_files(spark, listing)).collect()}
    assert rows == {"good.txt": None, "odd.txt": "CONVERSION_FAILED"}
