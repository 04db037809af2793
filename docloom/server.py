"""A thin HTTP front to the conversion job: upload, poll, download, preview, delete.

POST   /api/jobs                    multipart `file` parts      -> {id, status}
GET    /api/jobs/ID                                             -> converting with progress, completed with result, failed with error
GET    /api/jobs/ID/download                                    -> the archive, once completed
GET    /api/jobs/ID/preview?path=documents/x.md                 -> the document's body, looked up in the job's own list
DELETE /api/jobs/ID                                             -> always succeeds
GET    /health, /
"""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import threading
import uuid
from dataclasses import dataclass, field
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from docloom.functions import rules as R
from docloom.plans.job import Options, Rejected, preview, run_job

MAX_BODY = R.MAX_FILES * R.MAX_FILE_BYTES + (4 << 20)
PAGE = b"<!doctype html><title>docloom</title><form method=post action=/api/jobs enctype=multipart/form-data><input type=file name=file multiple><button>Convert</button></form>"


@dataclass
class Job:
    folder: str
    status: str = "converting"
    done: int = 0
    total: int = 0
    current: str | None = None
    result: dict = field(default_factory=dict)
    error: str | None = None


def safe_name(name: str) -> str:
    return re.sub("[^A-Za-z0-9._-]", "_", re.split(r"[/\\]", name)[-1])


def accepted(parts: list[tuple[str, bytes]], max_files: int = R.MAX_FILES) -> tuple[dict[str, bytes], str | None]:
    """Files to convert by safe name (a later one of equal name wins), or why none is left."""
    kept: dict[str, bytes] = {}
    empty = large = False
    for name, data in parts:
        name = safe_name(name)
        if os.path.splitext(name)[1].lower().lstrip(".") not in R.EXTENSIONS or len(kept) >= max_files:
            continue
        empty |= not data
        large |= len(data) > R.MAX_FILE_BYTES
        if 0 < len(data) <= R.MAX_FILE_BYTES:
            kept[name] = data
    if kept:
        return kept, None
    return kept, "The files are empty." if empty else R.MESSAGES["FILE_TOO_LARGE"] if large else R.MESSAGES["UNSUPPORTED_FILE"]


def multipart(content_type: str, body: bytes) -> list[tuple[str, bytes]]:
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    return [(p.get_filename() or "", p.get_payload(decode=True) or b"") for p in (message.iter_parts() if message.is_multipart() else ()) if p.get_param("name", header="content-disposition") == "file"]


class Jobs:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held, self.lock = spark, {}, threading.Lock()

    def start(self, files: dict[str, bytes]) -> str:
        folder = tempfile.mkdtemp(prefix="docloom-job-")
        os.mkdir(f"{folder}/in")
        for name, data in files.items():
            with open(f"{folder}/in/{name}", "wb") as f:
                f.write(data)
        key = f"job-{uuid.uuid4()}"
        job = Job(folder, total=len(files))
        with self.lock:
            self.held[key] = job
        threading.Thread(target=self._run, args=(job,), daemon=True).start()
        return key

    def _run(self, job: Job) -> None:
        def progress(done: int, total: int, current: str | None) -> None:
            job.done, job.total, job.current = done, total, current

        try:
            job.result = run_job(self.spark, [f"{job.folder}/in"], f"{job.folder}/export", Options(), progress)
            job.status = "completed"
        except Rejected as e:
            job.status, job.error = "failed", str(e)
        except Exception as e:  # noqa: BLE001  shown to whoever polls
            job.status, job.error = "failed", f"{type(e).__name__}: {e}"

    def get(self, key: str) -> Job | None:
        with self.lock:
            return self.held.get(key)

    def drop(self, key: str) -> None:
        with self.lock:
            job = self.held.pop(key, None)
        if job:
            shutil.rmtree(job.folder, ignore_errors=True)

    def body(self, job: Job, path: str) -> str | None:
        """The preview of one of the job's own documents; other paths are not looked at."""
        if path not in {f["output_file"] for f in job.result.get("files", [])}:
            return None
        with open(f"{job.folder}/export/{path}", encoding="utf-8") as f:
            stored = self.spark.createDataFrame([(path, f.read())], "output_file string, stored string")
        return preview(stored, path).first().body


def handler(jobs: Jobs) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: object, kind: str = "application/json", **headers: str) -> None:
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            for name, value in headers.items():
                self.send_header(name.replace("_", "-"), value)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            """File names are private: nothing is logged."""

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/api/jobs":
                return self.reply(404, {"error": "not found"})
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                return self.reply(400, {"error": R.MESSAGES["FILE_TOO_LARGE"]})
            files, why = accepted(multipart(self.headers.get("Content-Type") or "", self.rfile.read(size)))
            if why:
                return self.reply(400, {"error": why})
            return self.reply(200, {"id": jobs.start(files), "status": "converting"})

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            if url.path in ("/", "/health"):
                return self.reply(200, PAGE, "text/html") if url.path == "/" else self.reply(200, b"ok", "text/plain")
            m = re.fullmatch(r"/api/jobs/([^/]+)(?:/(download|preview))?", url.path)
            job = jobs.get(m[1]) if m else None
            if not job:
                return self.reply(404, {"error": "no such job"})
            if not m[2]:
                state = {"status": job.status}
                state |= {"done": job.done, "total": job.total, "current_file": job.current} if job.status == "converting" else {"result": job.result} if job.status == "completed" else {"error": job.error}
                return self.reply(200, state)
            if job.status != "completed":
                return self.reply(404, {"error": "not completed"})
            if m[2] == "download":
                with open(job.result["export_zip"], "rb") as f:
                    return self.reply(200, f.read(), "application/zip", Content_Disposition="attachment; filename=export.zip")
            body = jobs.body(job, (parse_qs(url.query).get("path") or [""])[0])
            return self.reply(404, {"error": "no such document"}) if body is None else self.reply(200, {"markdown": body})

        def do_DELETE(self) -> None:  # noqa: N802
            m = re.fullmatch(r"/api/jobs/([^/]+)", self.path)
            if m:
                jobs.drop(m[1])
            self.reply(200, {"deleted": True})

    return Handler


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server to be run by serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(Jobs(spark)))
