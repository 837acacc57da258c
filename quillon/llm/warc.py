"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member (a ``response`` record, or a
``revisit`` record that refers to the response with the same payload) in an
archive of its task.  Indexing: capture lines, keyed by the reversed-host form
of the URL, are range-partitioned and sorted; each partition is one index file of
compressed blocks, closed by a sparse directory with the first key of every
block.  Reading: keys are sent to their index file by binary search over the
files' first keys, to a block by binary search in its directory, and to the
record by a range read of the archive.

Archives and index files lie in the folder of ``spark.checkpoint.dir`` and are
opened through pyarrow's file systems.  A task writes under a name of its own
attempt and reports it in its rows; those rows are written as a table before
anything reads them, so an attempt that is lost or repeated leaves an orphan
file and nothing else.

Edge cases: null html is an empty payload; a null URL has the key ''; line
breaks and blanks in URLs are percent-encoded; payloads under ``min_revisit`` bytes
are always responses; rows repeated with their id are all responses; a null id
is a response unless another record has its payload; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, scratch, slices

#: Lines of a compressed index block; salts of a repeated payload in the join.
BLOCK_LINES, SALTS = 256, 16
#: Lines of an index file, which one task reads back: these, and more beyond so many files.
FILE_LINES, FILES = 8192, 4096
DATE = "2024-01-01T00:00:00Z"
_KNOWN, _UNKNOWN = 0x5157415243000001, 0x5157415243000002  # high words of record ids with and without a page id


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.a.org:80/x?y -> org,a,www)/x?y"""
    if not url:
        return ""
    url = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    port_text = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){parts.path or '/'}{query}"


def record_id(page_id: int | None) -> str:
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=_UNKNOWN << 64)}>"
    return f"<urn:uuid:{uuid.UUID(int=_KNOWN << 64 | page_id & (1 << 64) - 1)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = value & (1 << 64) - 1
    return None if value >> 64 == _UNKNOWN else low - (1 << 64 if low >> 63 else 0)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": headers, "type": headers["WARC-Type"], "payload": payload, "length": length}


def _input(uri: str):
    import pyarrow.fs as fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class OpenFiles:
    """The last few files that were asked for, closed as others come and at the end."""

    def __init__(self, most: int = 16) -> None:
        self.most, self.open = most, OrderedDict()

    def __enter__(self) -> OpenFiles:
        return self

    def __exit__(self, *_: object) -> None:
        while self.open:
            self.open.popitem()[1].close()

    def get(self, uri: str):
        if uri not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[uri] = _input(uri)
        self.open.move_to_end(uri)
        return self.open[uri]


def _output(folder: str, name: str):
    import pyarrow.fs as fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """Write the archives; returns the capture table
    (key, page_id, file, at, length) as written to the shared folder."""
    folder = scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    rows = rows.withColumn("digest", F.sha2(body, 256)).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    repeated = (
        rows.where(F.octet_length("html") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    joined = rows.join(repeated, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in slices(batches, "html"):
            out = out or _output(folder, name)
            keys, offsets, lengths = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers")]
            for page_id, url, html, digest, refers in zip(*columns, strict=True):
                member = build_record(page_id, url, html.encode(), digest, refers, refers is not None)
                out.write(member)
                keys.append(url_key(url))
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("page_id"), pa.array([name] * len(keys)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "page_id", "file", "at", "length"])
        if out:
            out.close()

    captures = materialise(joined.mapInArrow(write, "key string, page_id long, file string, at long, length long"), "warc-captures")
    return captures.withColumn("folder", F.lit(folder))


def _line(key: str, page_id: int | None) -> tuple[str, int]:
    return key, -(1 << 63) if page_id is None else page_id


def write_index(captures: DataFrame) -> DataFrame:
    """Write the index files; returns their table (folder, file, first_key, first_id)."""
    folder = scratch(captures.sparkSession, "cdx")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, out, directory, lines, first = f"{uuid.uuid4().hex}.cdx", 0, None, [], [], None

        def close_block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(lines).encode(), 3)
            head = lines[0].split("\t")
            directory.append(f"{head[0]}\t{head[1]}\t{at}\t{len(data)}")
            out.write(data)
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "folder", "file", "at", "length")], strict=True):
                if out is None:
                    out, first = _output(folder, name), row
                lines.append("\t".join("" if x is None else str(x).replace("\t", "%09") for x in row))
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out:
            if lines:
                close_block()
            data = zlib.compress("\n".join(directory).encode(), 6)
            out.write(data + len(data).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([name]), pa.array([first[0]]), pa.array([first[1]], pa.int64())], ["folder", "file", "first_key", "first_id"])

    n = captures.count()
    files = max(1, min(-(-n // FILE_LINES), FILES), -(-n // (1 << 18)))
    ordered = captures.repartitionByRange(files, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "at")
    return materialise(ordered.mapInArrow(pack, "folder string, file string, first_key string, first_id long"), "cdx-files")


def _parse(line: str) -> tuple[str, int, list[str]]:
    parts = line.split("\t")
    return (*_line(parts[0], int(parts[1]) if parts[1] else None), parts[2:])


class IndexFile:
    """Binary search over the sparse directory, then one range read per block."""

    def __init__(self, file) -> None:
        self.file = file
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.blocks = [_parse(x) for x in zlib.decompress(self.file.read_at(length, size - 8 - length)).decode().split("\n")]
        self.first = [b[:2] for b in self.blocks]
        self.last: tuple[int, list] = (-1, [])

    def block(self, k: int) -> list:
        if self.last[0] != k:
            at, length = map(int, self.blocks[k][2])
            self.last = (k, [_parse(x) for x in zlib.decompress(self.file.read_at(length, at)).decode().split("\n")])
        return self.last[1]

    def find(self, key: str, page_id: int | None) -> Iterator[list[str]]:
        """Captures (folder, file, at, length) of a key; there may be several."""
        wanted = _line(key, page_id)
        k = max(0, bisect.bisect_left(self.first, wanted) - 1)
        while k < len(self.blocks) and self.first[k] <= wanted:
            lines = self.block(k)
            at = bisect.bisect_left(lines, wanted, key=lambda x: x[:2])
            while at < len(lines) and lines[at][:2] == wanted:
                yield lines[at][2]
                at += 1
            k += 1


def _captured(member: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and html of a record."""
    got = parse_record(member)
    headers, page = got["headers"], page_of(got["headers"]["WARC-Record-ID"])
    if got["type"] == "response":
        return page, len(got["payload"]), hashlib.sha256(got["payload"]).hexdigest(), got["type"], None, got["payload"].decode()
    return page, got["length"], headers["WARC-Payload-Digest"].removeprefix("sha256:"), got["type"], page_of(headers["WARC-Refers-To"]), None


def read_back(pages: DataFrame, index: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Look every page up in the index and read its record:
    (page_id, payload_bytes, payload_digest, record_type, refers_to, html)."""
    files = sorted(((*_line(r["first_key"], r["first_id"]), f"{r['folder']}/{r['file']}") for r in index.collect()), key=lambda x: x[:2])  # one row per index partition
    starts = [f[:2] for f in files]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [url_key(u).replace("\t", "%09") for u in batch.column("url").to_pylist()], batch.column("page_id").to_pylist()
            at = [max(0, bisect.bisect_right(starts, _line(k, i)) - 1) for k, i in zip(keys, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys), batch.column("page_id")], ["file", "key", "page_id"])

    wanted = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(assign, "file int, key string, page_id long").distinct()
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"

    def fetch(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = []
        with OpenFiles() as opened:
            index_file = IndexFile(opened.get(files[key[0].as_py()][2]))
            for batch in batches:
                for k, i in sorted(zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True), key=lambda x: _line(*x)):
                    spots += [(f"{folder}/{file}", int(start), int(length)) for folder, file, start, length in index_file.find(k, i)]
            spots.sort()  # each archive is read front to back
            for begin in range(0, len(spots), 256):
                rows = [_captured(opened.get(uri).read_at(length, start)) for uri, start, length in spots[begin : begin + 256]]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    return wanted.groupBy("file").applyInArrow(fetch, schema)


#: DuckDB, over the view ``pages``.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
