"""WARC archives with a two-level capture index (operator 5).

``write`` stores one record per page, each a gzip member of its own, and returns the captures. ``index``
sorts them by reversed-host URL key, packs runs of lines into gzip blocks and keeps a sparse directory
with each block's first key. ``fetch`` answers keys: binary search in the directory, one block read,
binary search among its lines, then a range read of just that record.

Scale: payloads move once, to meet the first capture of their digest; a digest that a large share of the
pages has is split by adaptive query execution. The index is sorted by ranges of (key, page_id), so one
host, however common, spreads over tasks. The directory has one row per ``BLOCK`` captures and is read
by the tasks that need it, never by the driver.

Defined cases: a null html has an empty payload; empty payloads are deduplicated like others; a null url
has the key ``-``; in keys, all but printable ASCII is escaped; rows that repeat page_id and html give equal records, all of type response where that
page_id is the least of its payload; a null page_id is only the least where no row of its payload has one; other columns are ignored;
an empty table writes nothing.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, attempt_name, open_fs
from .worker import guarded, pieces

#: Captures in a block of the index; the format's version line and its revisit profile (fixed values).
BLOCK = 2048
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CAPTURES = "key string, page_id long, record_type string, file string, at long, size long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, on one line of ASCII: ``org,example)/a?b``."""
    return _ascii(_key(url.strip())) if url and url.strip() else "-"


def _key(url: str) -> str:
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").strip("."), u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    port = f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else ""
    labels = host.split(".")
    while len(labels) > 1 and labels[0] == "www":
        labels = labels[1:]
    return f"{','.join(reversed(labels))}{port}){(u.path or '/').lower()}" + (f"?{u.query.lower()}" if u.query else "")


def _ascii(x: str) -> str:
    """A header's value on one line of ASCII."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in x)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit has the response's headers alone, with the full payload's length."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _ascii(url or "urn:none")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says: its type, page_id, refers_to, payload_bytes, payload_digest and payload.

    The digest of a response is computed from the payload that was read, and has to be the one it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError("not a WARC record")
    says = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(says["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda k: (lambda x: None if x == "None" else int(x))(says[k][10:-1])
    digest, revisit = says["WARC-Payload-Digest"][5:], says["WARC-Type"] == "revisit"
    if not revisit:
        digest = sha1(payload)
        if digest != says["WARC-Payload-Digest"][5:] or len(payload) != length:
            raise ValueError(f"damaged record {says['WARC-Record-ID']}")
    return {"record_type": says["WARC-Type"], "page_id": number("WARC-Record-ID"), "refers_to": number("WARC-Refers-To") if revisit else None, "payload_bytes": length, "payload_digest": digest, "payload": payload}


def sha1(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of a schema of longs and strings."""
    named = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(named)
    return pa.record_batch([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, (_, k) in zip(cols, named, strict=True)], [n for n, _ in named])


def write(pages: DataFrame, ws: Workspace) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and returns their captures."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = p.groupBy("sha").agg(F.min("page_id").alias("first"))
    met = p.join(first, "sha").select("page_id", "url", "html", "sha", "first")
    folder = f"{ws.path}/warc"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, at, file = None, 0, attempt_name() + ".warc.gz"
        for part in pieces("warc", parts, "html"):
            rows = []
            for page_id, url, html, sha, least in zip(*(part.column(i) for i in range(5)), strict=True):
                if sink is None:
                    fs, where = open_fs(folder)
                    fs.create_dir(where, recursive=True)
                    sink = fs.open_output_stream(f"{where}/{file}", compression=None)
                page_id, least, url = page_id.as_py(), least.as_py(), url.as_py()
                refers_to = None if page_id == least or least is None else least
                payload = html.as_buffer().to_pybytes()
                member = gzip.compress(record(page_id, url, payload, base64.b32encode(sha.as_py()).decode(), refers_to), 6, mtime=0)
                sink.write(member)
                rows.append((url_key(url), page_id, "response" if refers_to is None else "revisit", file, at, len(member)))
                at += len(member)
            yield _batch(rows, _CAPTURES)
        if sink is not None:
            sink.close()

    return ws.save(met.mapInArrow(task, _CAPTURES), "captures")


def _tasks(spark: SparkSession) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


_DIRECTORY = "key string, id long, last_key string, last_id long, at long, size long, lines long"
_FILES = "key string, id long, last_key string, last_id long, file string, blocks long"


def index(captures: DataFrame, ws: Workspace, block: int = BLOCK) -> str:
    """Writes the blocks, their directories and the table of index files; returns the index's folder."""
    ordered = captures.select("key", F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "file", "at", "size")
    ordered = ordered.repartitionByRange(_tasks(captures.sparkSession), "key", "id").sortWithinPartitions("key", "id")
    folder = f"{ws.path}/index"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, at, file, held, rows = None, 0, attempt_name() + ".idx.gz", [], []

        def put(lines):
            nonlocal sink, at
            if sink is None:
                fs, where = open_fs(folder)
                fs.create_dir(where, recursive=True)
                sink = fs.open_output_stream(f"{where}/{file}", compression=None)
            data = gzip.compress("".join("\t".join(map(str, x)) + "\n" for x in lines).encode(), 6, mtime=0)
            sink.write(data)
            rows.append((*lines[0][:2], *lines[-1][:2], at, len(data), len(lines)))
            at += len(data)

        for part in guarded("warc", parts):
            held += list(zip(*(part.column(c).to_pylist() for c in ("key", "id", "file", "at", "size")), strict=True))
            while len(held) >= block:
                put(held[:block])
                held = held[block:]
        if held:
            put(held)
        if sink is not None:
            sink.close()
            fs, where = open_fs(folder)
            with fs.open_output_stream(f"{where}/{file}.directory", compression=None) as out, pa.ipc.new_file(out, _batch([], _DIRECTORY).schema) as writer:
                writer.write_batch(_batch(rows, _DIRECTORY))
            yield _batch([(*rows[0][:2], *rows[-1][2:4], file, len(rows))], _FILES)

    # one row per index file, then one file of them: that is what every task of a fetch reads
    ws.save(ws.save(ordered.mapInArrow(task, _FILES), "index-files").coalesce(1), "directory")
    return folder


class CaptureIndex:
    """Looks up captures in a written index; what it has read last stays at hand."""

    def __init__(self, folder: str, directory: str):
        import pyarrow.parquet as pq

        self.fs, self.at = open_fs(folder)
        fs, at = open_fs(directory)
        rows = pq.read_table(at, filesystem=fs).to_pylist()
        # a null page_id has the least number as its id; equal keys may cross a file's or a block's edge
        self.files = sorted(rows, key=lambda r: (r["key"], r["id"], r["last_key"], r["last_id"]))
        self.firsts = [(r["key"], r["id"]) for r in self.files]
        self.directories: dict[str, tuple[list, list]] = {}
        self.held: dict[tuple, list] = {}
        self.open: dict = {}

    def _read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(name)
        return self.open[name].read_at(size, at)

    def _directory(self, file: str) -> tuple[list, list]:
        if file not in self.directories:
            if len(self.directories) >= 4:
                self.directories.pop(next(iter(self.directories)))
            with self.fs.open_input_file(f"{self.at}/{file}.directory") as f:
                rows = pa.ipc.open_file(f).read_all().to_pylist()
            self.directories[file] = rows, [(r["key"], r["id"]) for r in rows]
        return self.directories[file]

    def _block(self, file: str, b: dict) -> list:
        at = file, b["at"]
        if at not in self.held:
            if len(self.held) >= 4:
                self.held.pop(next(iter(self.held)))
            lines = [x.split("\t") for x in gzip.decompress(self._read(f"{self.at}/{file}", b["at"], b["size"])).decode().split("\n")[:-1]]
            self.held[at] = [(x[0], int(x[1]), x[2], int(x[3]), int(x[4])) for x in lines]
        return self.held[at]

    @staticmethod
    def _from(firsts: list, low: tuple) -> int:
        return max(0, bisect.bisect_left(firsts, low) - 1)

    def find(self, key: str, page_id: int | None = None) -> list[tuple]:
        """Captures (key, id, file, at, size) of a key, or those of one page with it."""
        low = (key, -(1 << 63) if page_id is None else page_id)
        past = lambda first: first > low and (first[0] != key or page_id is not None and first[1] != page_id)
        found = []
        for i in range(self._from(self.firsts, low), len(self.files)):
            if past(self.firsts[i]):
                break
            blocks, firsts = self._directory(self.files[i]["file"])
            for k in range(self._from(firsts, low), len(blocks)):
                if past(firsts[k]):
                    break
                lines = self._block(self.files[i]["file"], blocks[k])
                for x in lines[bisect.bisect_left(lines, low) :]:
                    if x[0] != key or page_id is not None and x[1] != page_id:
                        break
                    found.append(x)
        return found

    def record(self, archives: str, capture: tuple) -> dict:
        """Range-reads one record."""
        return parse(zlib.decompress(self._read(f"{open_fs(archives)[1]}/{capture[2]}", capture[3], capture[4]), 31))


def fetch(keys: DataFrame, ws: Workspace) -> DataFrame:
    """The records of all ``keys`` (url, page_id), each looked up in the index and read by its range."""
    archives, folder, directory = (f"{ws.path}/{x}" for x in ("warc", "index", "directory"))

    @F.arrow_udf("string")
    def key(urls: pa.Array) -> pa.Array:
        return pa.array([url_key(u) for u in urls.to_pylist()], pa.string())

    # keys go to tasks in the index's order, so that a task reads each block once
    asked = keys.select(F.col("page_id").cast("long").alias("page_id"), key("url").alias("key")).distinct()
    asked = asked.repartitionByRange(_tasks(keys.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for part in guarded("warc", parts, 1 << 16):
            found = found or CaptureIndex(folder, directory)
            rows = []
            for key, page_id in zip(part.column("key").to_pylist(), part.column("page_id").to_pylist(), strict=True):
                for c in found.find(key, -(1 << 63) if page_id is None else page_id):
                    r = found.record(archives, c)
                    rows.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
            yield _batch(rows, kind)

    return asked.mapInArrow(task, kind)
