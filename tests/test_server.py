import io
import json
import threading
import time
import urllib.error
import urllib.request
import zipfile

import pytest

from docloom.server import accepted, multipart, safe_name, serve


def test_uploads():
    assert safe_name("../a b\\é?.txt") == "__.txt" and safe_name("x/My File.md") == "My_File.md"
    assert accepted([("a.txt", b"x"), ("b.exe", b"x"), ("c.md", b"")])[0] == {"a.txt": b"x"}
    assert "empty" in accepted([("c.md", b"")])[1] and accepted([("c.exe", b"x")])[1] and accepted([])[1]
    assert len(accepted([(f"{i}.md", b"x") for i in range(30)])[0]) == 25


def form(files):
    body = b"".join(f'--B\r\nContent-Disposition: form-data; name="file"; filename="{n}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + d + b"\r\n" for n, d in files) + b"--B--\r\n"
    return "multipart/form-data; boundary=B", body


def test_multipart():
    assert multipart(*form([("a.md", b"# x"), ("b.csv", b"a,b")])) == [("a.md", b"# x"), ("b.csv", b"a,b")]
    assert multipart("text/plain", b"x") == []


def test_server(spark):
    server = serve(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{server.server_port}"
    call = lambda path, **k: urllib.request.urlopen(urllib.request.Request(top + path, **k), timeout=60).read()
    try:
        assert call("/health") == b"ok" and b"form" in call("/")
        kind, body = form([("a b.md", b"# Hello\n\nSome text of a note."), ("bad.exe", b"x")])
        key = json.loads(call("/api/jobs", data=body, headers={"Content-Type": kind}, method="POST"))["id"]
        for _ in range(240):
            state = json.loads(call(f"/api/jobs/{key}"))
            if state["status"] != "converting":
                break
            time.sleep(0.5)
        assert state["status"] == "completed" and state["result"]["exit_code"] == 0
        assert "documents/a-b-md.md" in zipfile.ZipFile(io.BytesIO(call(f"/api/jobs/{key}/download"))).namelist()
        assert json.loads(call(f"/api/jobs/{key}/preview?path=documents/a-b-md.md"))["markdown"] == "# Hello\n\nSome text of a note."
        for bad in (f"/api/jobs/{key}/preview?path=../../in/a_b.md", "/api/jobs/none", "/nothing"):
            with pytest.raises(urllib.error.HTTPError) as e:
                call(bad)
            assert e.value.code == 404
        with pytest.raises(urllib.error.HTTPError) as e:
            call("/api/jobs", data=form([("x.exe", b"x")])[1], headers={"Content-Type": kind}, method="POST")
        assert e.value.code == 400
        assert json.loads(call(f"/api/jobs/{key}", method="DELETE")) == json.loads(call("/api/jobs/none", method="DELETE")) == {"deleted": True}
        with pytest.raises(urllib.error.HTTPError):
            call(f"/api/jobs/{key}")
    finally:
        server.shutdown()
