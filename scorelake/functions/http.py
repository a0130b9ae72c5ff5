"""HTTP requests of drivers and executors: JSON, form and multipart bodies, separate limits for connecting and reading."""

from __future__ import annotations

import http.client
import json
import secrets
from dataclasses import dataclass, field
from urllib.parse import urlencode, urljoin, urlsplit


@dataclass
class Answer:
    status: int
    data: bytes
    headers: dict[str, str] = field(default_factory=dict)

    @property
    def text(self) -> str:
        return self.data.decode(errors="replace")

    def json(self) -> object:
        return json.loads(self.text)


@dataclass
class File:
    """A part of a multipart body that is a file."""

    name: str
    data: bytes
    kind: str = "application/octet-stream"


def encoded(body: object, encoding: str) -> tuple[bytes | None, str | None]:
    """Bytes and content type of a body: json, form, or multipart, for a dict whose values may be Files. Bytes and text go as they are."""
    if body is None or isinstance(body, bytes):
        return body, None
    if isinstance(body, str):
        return body.encode(), "text/plain; charset=utf-8"
    if encoding == "json":
        return json.dumps(body, ensure_ascii=False).encode(), "application/json"
    if encoding == "form":
        return urlencode(body, doseq=True).encode(), "application/x-www-form-urlencoded"
    if encoding != "multipart":
        raise ValueError(f"encoding must be json, form or multipart: {encoding}")
    mark, out = secrets.token_hex(16), []
    quoted = lambda s: str(s).replace("\\", "\\\\").replace('"', '\\"').replace("\r", " ").replace("\n", " ")
    for name, value in body.items():
        for one in value if isinstance(value, list) else [value]:
            head = f'--{mark}\r\nContent-Disposition: form-data; name="{quoted(name)}"'
            if isinstance(one, File):
                out += [f'{head}; filename="{quoted(one.name)}"\r\nContent-Type: {one.kind}\r\n\r\n'.encode(), one.data, b"\r\n"]
            else:
                out.append(f"{head}\r\n\r\n{one}\r\n".encode())
    out.append(f"--{mark}--\r\n".encode())
    return b"".join(out), f"multipart/form-data; boundary={mark}"


def request(
    url: str, method: str = "GET", params: dict | None = None, headers: dict | None = None, body: object = None, encoding: str = "json",
    connect_timeout: float = 10, read_timeout: float = 120, redirects: int = 5,
) -> Answer:
    """One request; certificates are verified. Redirects of requests without a body are followed."""
    if params:
        url += ("&" if urlsplit(url).query else "?") + urlencode(params, doseq=True)
    data, kind = encoded(body, encoding)
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ValueError(f"neither http nor https: {url}")
    make = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
    connection = make(parts.hostname, parts.port, timeout=connect_timeout)
    try:
        connection.connect()
        connection.sock.settimeout(read_timeout)
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        connection.request(method, target, data, ({"Content-Type": kind} if kind else {}) | (headers or {}))
        answer = connection.getresponse()
        out = Answer(answer.status, answer.read(), {k.lower(): v for k, v in answer.getheaders()})
    finally:
        connection.close()
    if out.status in (301, 302, 303, 307, 308) and data is None and redirects and "location" in out.headers:
        return request(urljoin(url, out.headers["location"]), method, None, headers, None, encoding, connect_timeout, read_timeout, redirects - 1)
    return out
