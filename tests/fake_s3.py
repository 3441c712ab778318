"""A small S3-compatible service in this process: enough for a file system client to write, read, list and delete."""

from __future__ import annotations

import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit
from xml.sax.saxutils import escape


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *args) -> None:
        return None

    def _answer(self, code: int, body: bytes = b"", **headers: str) -> None:
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", headers.pop("length", str(len(body))))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def _where(self) -> tuple[str, str, dict[str, list[str]]]:
        parts = urlsplit(self.path)
        bucket, _, key = unquote(parts.path).lstrip("/").partition("/")
        return bucket, key, parse_qs(parts.query, keep_blank_values=True)

    def _body(self) -> bytes:
        if "chunked" in self.headers.get("Transfer-Encoding", ""):
            raw = b""
            while n := int(self.rfile.readline().split(b";")[0], 16):
                raw += self.rfile.read(n)
                self.rfile.readline()
            self.rfile.readline()
        else:
            raw = self.rfile.read(int(self.headers.get("Content-Length", 0)))
        if "aws-chunked" not in self.headers.get("Content-Encoding", "") and "x-amz-decoded-content-length" not in self.headers:
            return raw
        out, at = b"", 0
        while True:  # sizes in hex, then data
            end = raw.index(b"\r\n", at)
            n = int(raw[at:end].split(b";")[0], 16)
            if not n:
                return out
            out += raw[end + 2 : end + 2 + n]
            at = end + 4 + n

    def do_PUT(self) -> None:
        bucket, key, query = self._where()
        data, store = self._body(), self.server.objects
        if not key:
            self.server.buckets.add(bucket)
        elif "partNumber" in query:
            self.server.uploads[query["uploadId"][0]][int(query["partNumber"][0])] = data
        else:
            store[bucket, key] = data
        self._answer(200, ETag='"e"')

    def do_POST(self) -> None:
        bucket, key, query = self._where()
        body = self._body()
        if "uploads" in query:
            name = f"u{len(self.server.uploads)}"
            self.server.uploads[name] = {}
            self._answer(200, f"<InitiateMultipartUploadResult><Bucket>{bucket}</Bucket><Key>{escape(key)}</Key><UploadId>{name}</UploadId></InitiateMultipartUploadResult>".encode())
        elif "uploadId" in query:
            parts = self.server.uploads[query["uploadId"][0]]
            self.server.objects[bucket, key] = b"".join(parts[i] for i in sorted(parts))
            self._answer(200, f"<CompleteMultipartUploadResult><Key>{escape(key)}</Key><ETag>e</ETag></CompleteMultipartUploadResult>".encode())
        else:  # delete several
            for gone in re.findall(rb"<Key>(.*?)</Key>", body):
                self.server.objects.pop((bucket, gone.decode()), None)
            self._answer(200, b"<DeleteResult></DeleteResult>")

    def do_DELETE(self) -> None:
        bucket, key, _ = self._where()
        self.server.objects.pop((bucket, key), None)
        self._answer(204)

    def do_HEAD(self) -> None:
        bucket, key, _ = self._where()
        if not key:
            self._answer(200 if bucket in self.server.buckets else 404)
        elif (bucket, key) in self.server.objects:
            self._answer(200, length=str(len(self.server.objects[bucket, key])), ETag='"e"', Last_Modified="Mon, 01 Jan 2024 00:00:00 GMT")
        else:
            self._answer(404)

    def do_GET(self) -> None:
        bucket, key, query = self._where()
        if key:
            if (data := self.server.objects.get((bucket, key))) is None:
                self._answer(404, b"<Error><Code>NoSuchKey</Code></Error>")
                return
            if found := re.match(r"bytes=(\d+)-(\d*)", self.headers.get("Range", "")):
                a, b = int(found[1]), min(int(found[2] or len(data) - 1), len(data) - 1)
                self._answer(206, data[a : b + 1], Content_Range=f"bytes {a}-{b}/{len(data)}", ETag='"e"', Last_Modified="Mon, 01 Jan 2024 00:00:00 GMT")
            else:
                self._answer(200, data, ETag='"e"', Last_Modified="Mon, 01 Jan 2024 00:00:00 GMT")
            return
        prefix, mark = query.get("prefix", [""])[0], query.get("delimiter", [""])[0]
        names = sorted(k for b, k in self.server.objects if b == bucket and k.startswith(prefix))
        rows, folders = [], set()
        for name in names:
            rest = name[len(prefix) :]
            if mark and mark in rest:
                folders.add(prefix + rest.split(mark)[0] + mark)
            else:
                rows.append(f"<Contents><Key>{escape(name)}</Key><Size>{len(self.server.objects[bucket, name])}</Size><LastModified>2024-01-01T00:00:00.000Z</LastModified></Contents>")
        rows += [f"<CommonPrefixes><Prefix>{escape(f)}</Prefix></CommonPrefixes>" for f in sorted(folders)]
        count = len(rows)
        self._answer(200, f"<ListBucketResult><Name>{bucket}</Name><Prefix>{escape(prefix)}</Prefix><KeyCount>{count}</KeyCount><IsTruncated>false</IsTruncated>{''.join(rows)}</ListBucketResult>".encode())


class FakeS3:
    def __enter__(self) -> FakeS3:
        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.server.objects, self.server.uploads, self.server.buckets = {}, {}, {"frames"}
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *args) -> None:
        self.server.shutdown()
        self.server.server_close()

    @property
    def objects(self) -> dict[tuple[str, str], bytes]:
        return self.server.objects
