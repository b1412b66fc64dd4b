"""Uploads, progress, results and history over HTTP, in front of the inbox and the tables of service.py."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from email import policy
from email.message import Message
from email.parser import BytesParser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qsl

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from . import service

#: Bytes of an upload at most.
MOST = 64 << 20


#: What uploads may be, by the type that their sender states.
TYPES = {"application/json": ".json", "application/pdf": ".pdf", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx"}


def upload(headers: Message, body: bytes) -> tuple[str, bytes] | None:
    """(file name, content) of a request: the first file of a form, or the whole body, named by X-Filename or by its type."""
    kind = headers.get_content_type()
    if kind == "multipart/form-data":
        form = BytesParser(policy=policy.HTTP).parsebytes(f"Content-Type: {headers['Content-Type']}\r\n\r\n".encode() + body)
        found = next((p for p in form.iter_parts() if p.get_filename()), None) if form.is_multipart() else None
        return (found.get_filename(), found.get_payload(decode=True) or b"") if found else None
    return headers.get("X-Filename") or f"upload{TYPES.get(kind, '.json')}", body


def _lookup(spark: SparkSession, out: str, job_id: str) -> tuple[int, object]:
    """A job's progress; 404 if no batch has taken it yet."""
    row = service.job(spark, out, job_id)
    if row is None:
        return 404, {"error": "unknown job"}
    return 200, {k: row[k] for k in ("job_id", "status", "phase", "progress", "detail")}


def _result(spark: SparkSession, out: str, job_id: str) -> tuple[int, object]:
    status, text = service.result(spark, out, job_id)
    return (200, json.loads(text)) if status == 200 else (status, {"error": "not done" if status == 409 else "unknown job"})


def _history(spark: SparkSession, folder: str, size: int, after: str | None) -> tuple[int, object]:
    """A page of the result files, and where the next one begins."""
    try:
        rows, following = service.history_page(spark, folder, size, after)
    except AnalysisException:  # there is no such folder yet
        rows, following = [], None
    return 200, {"rows": rows, "next": following}


def server(spark: SparkSession, inbox: str, out: str, history: str, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """POST /upload; GET /progress/<job>, /result/<job>, /history?size=&after=, /history/<job> and /status. Call serve_forever() on what is returned.

    An upload (a form's file, or a body) is written beside the inbox and moved in, so the stream never sees a part of
    a file. inbox and history
    are local folders of the machine that runs this.
    """
    inbox_dir = Path(inbox)
    inbox_dir.mkdir(parents=True, exist_ok=True)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/upload":
                return self.answer(404, {"error": "no such path"})
            if not 0 < size <= MOST:
                return self.answer(413 if size > MOST else 400, {"error": "no body, or too large"})
            sent = upload(self.headers, self.rfile.read(size))
            if not sent or not sent[1]:
                return self.answer(400, {"error": "no file"})
            extension = Path(sent[0]).suffix.lower()
            if extension not in service.FORMATS:
                return self.answer(415, {"error": f"none of {', '.join(service.FORMATS)}"})
            job_id = uuid.uuid4().hex[:12]
            with tempfile.NamedTemporaryFile(dir=inbox_dir.parent, delete=False) as f:
                f.write(sent[1])
            Path(f.name).rename(inbox_dir / f"{job_id}{extension}")
            self.answer(202, {"job_id": job_id})

        def do_GET(self) -> None:
            path, _, asked = self.path.partition("?")
            m = re.fullmatch(r"/(progress|result|history)/([0-9a-f]{12})", path)
            if m and m[1] == "progress":
                return self.answer(*_lookup(spark, out, m[2]))
            if m and m[1] == "result":
                return self.answer(*_result(spark, out, m[2]))
            if m:
                p = Path(history) / f"{m[2]}.json"
                return self.answer(200, json.loads(p.read_text())) if p.exists() else self.answer(404, {"error": "unknown job"})
            if path == "/history":
                by = dict(parse_qsl(asked))
                size, after = by.get("size", "50"), by.get("after")
                if not re.fullmatch(r"[1-9]\d{0,2}", size) or not re.fullmatch(r"\d+-[0-9a-f]{12}", after or "0-000000000000"):
                    return self.answer(400, {"error": "size is 1 to 999, after a key that a page gave"})
                return self.answer(*_history(spark, history, int(size), after))
            if path == "/status":
                return self.answer(200, {"streams": [{"name": q.name, "active": q.isActive, "message": q.status["message"]} for q in spark.streams.active]})
            self.answer(404, {"error": "no such path"})

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
