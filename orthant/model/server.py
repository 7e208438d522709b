"""A completion service over HTTP for one model: tags, running models, description, and generation, whole or streamed.

It serves single prompts beside a cluster; tables of prompts are completed by `transformers.continuation`.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

#: Tokens generated where a request names no number.
PREDICT = 256
CANDIDATES = 64


def _details(family: str) -> dict:
    return {"format": "gguf", "family": family, "parameter_size": "unknown", "quantization_level": "float32"}


def answer(model, name: str, family: str, method: str, path: str, body: dict):
    """(status, answer) of a request; the answer is an object, or an iterator of objects for a streamed one."""
    now = datetime.now(timezone.utc)
    if (method, path) == ("GET", "/api/tags"):
        return 200, {"models": [{"name": name, "model": name, "modified_at": now.isoformat(), "size": 0, "digest": "", "details": _details(family)}]}
    if (method, path) == ("GET", "/api/ps"):
        return 200, {"models": [{"name": name, "model": name, "size": 0, "digest": "", "expires_at": (now + timedelta(hours=24)).isoformat()}]}
    if (method, path) == ("POST", "/api/show"):
        info = {"general.architecture": family, "general.context_length": 2048, "general.embedding_length": model.dims, "general.type": "model"}
        return 200, {"modelfile": "", "parameters": "", "template": "", "license": "", "details": _details(family) | {"families": family}, "model_info": info}
    if (method, path) == ("POST", "/api/generate"):
        most = (body.get("options") or {}).get("num_predict", PREDICT)
        texts = model.generate(body.get("prompt") or "", most, CANDIDATES)
        if not body.get("stream", True):
            return 200, {"model": name, "response": "".join(texts), "done": True}
        return 200, (x for part in (({"model": name, "response": t, "done": False} for t in texts), [{"model": name, "response": "", "done": True}]) for x in part)
    return 404, {"error": f"Not found: {path}"}


def server(model, name: str, family: str, port: int = 0) -> ThreadingHTTPServer:
    """A server that answers with a model (dims; generate(prompt, most, candidates) yields texts) once serve_forever() is called."""

    class Handler(BaseHTTPRequestHandler):
        def _handle(self):
            try:
                size = int(self.headers.get("Content-Length") or 0)
                status, found = answer(model, name, family, self.command, self.path.split("?")[0], json.loads(self.rfile.read(size) or b"{}"))
            except Exception as error:  # reported to the client, as the service goes on
                status, found = 500, {"error": str(error)}
            whole = isinstance(found, dict)
            self.send_response(status)
            self.send_header("Content-Type", "application/json" if whole else "application/x-ndjson")
            self.end_headers()
            for part in [found] if whole else found:
                self.wfile.write(json.dumps(part).encode() + (b"" if whole else b"\n"))
                self.wfile.flush()

        do_GET = do_POST = _handle

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
