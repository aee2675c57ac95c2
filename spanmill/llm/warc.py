"""WARC files as a PySpark data source.

``df.write.format("warc")`` writes one file (or more, from ``max_bytes`` on)
for each task, one gzip member for each record, and beside it an index with
the offset, size and chief headers of every record. ``spark.read.format("warc")``
plans one partition for each file. Filters on the record type and other header
columns are pushed down: they are decided on the index where there is one, so
unwanted records aren't even read; else on the record's headers, which are
parsed first: payloads that aren't wanted are skipped in pieces, neither
gathered nor decoded. Plain ``.warc`` files are read, too.

Read options: ``payload`` = ``text`` (default), or ``digest``: the payload is
checked and measured but not decoded or sent on.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from spanmill.llm.common import shared_dir

SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload string"
#: Smallest payload for which a revisit record stands in.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
_HEADER_COLUMNS = {"page_id", "url", "record_type", "payload_digest", "refers_to"}
_LEVEL = 1
#: Bytes of a file that are read at a time where there is no index.
_PIECE = 1 << 16


def _storage(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a URI or a local path."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _page_of(record_id: str | None) -> int | None:
    return int(record_id.strip("<>").rpartition(":")[2]) if record_id else None


def _field(value: str) -> str:
    """A header value on one line: control characters and percent signs become percent escapes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def _unfield(value: str) -> str:
    out, at = [], 0
    while (k := value.find("%", at)) >= 0:
        out += [value[at:k], chr(int(value[k + 1 : k + 3], 16))]
        at = k + 3
    return "".join(out) + value[at:]


def build_record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, headers and block; a revisit holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_field(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    """Header lines as a map with lower-case names."""
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _summary(head: dict[str, str]) -> dict:
    """The columns that headers decide."""
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    return {
        "page_id": _page_of(head.get("warc-record-id")),
        "url": _unfield(head["warc-target-uri"]) if "warc-target-uri" in head else None,
        "record_type": head.get("warc-type"),
        "payload_digest": base64.b32decode(digest).hex() if digest else None,
        "refers_to": _page_of(head.get("warc-refers-to")),
    }


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes under a name that readers skip; ``commit`` gives the files their names."""

    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes, self.job = path, max_bytes, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, root = _storage(self.path)
        store.create_dir(root, recursive=True)
        files: list[str] = []
        out = index = None
        size = 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in columns), strict=True):
                if out is None:
                    name = f"{self.job}-{uuid.uuid4().hex}"
                    files.append(name)
                    out, index = (store.open_output_stream(posixpath.join(root, f"_{name}.{kind}"), compression=None) for kind in ("warc.gz", "idx"))
                    size = 0
                packed = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                member = packed.compress(build_record(page_id, url, (payload or "").encode(), digest, refers_to)) + packed.flush()
                out.write(member)
                entry = {"at": size, "size": len(member), "page_id": page_id, "url": url, "record_type": "response" if refers_to is None else "revisit", "payload_digest": digest, "refers_to": refers_to}
                index.write(json.dumps(entry).encode() + b"\n")
                size += len(member)
                if size >= self.max_bytes:
                    out.close(), index.close()
                    out = None
        if out is not None:
            out.close(), index.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = _storage(self.path)
        for m in messages:
            for name in m.files if m else []:
                for kind in ("idx", "warc.gz"):
                    store.move(posixpath.join(root, f"_{name}.{kind}"), posixpath.join(root, f"{name}.{kind}"))

    def abort(self, messages) -> None:
        store, root = _storage(self.path)
        for m in messages:
            for name in m.files if m else []:
                for kind in ("idx", "warc.gz"):
                    store.delete_file(posixpath.join(root, f"_{name}.{kind}"))


@dataclass
class WarcFile(InputPartition):
    path: str
    index: str | None


_TESTS = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    IsNotNull: lambda v, _: True,
}


class _Stream:
    """Records of a file without an index, read once from its start in small pieces.

    Members of a gzip file follow each other as one stream, however records are
    dealt to them. What is skipped is inflated piece by piece and dropped, or
    in a plain file not even read.
    """

    def __init__(self, source, packed: bool):
        self.source, self.packed = source, packed
        self.inflate, self.left, self.buffer = None, b"", b""

    def _more(self) -> bytes:
        """The next piece, empty at the end of the file."""
        if not self.packed:
            return self.source.read(_PIECE)
        while True:
            if not self.left:
                self.left = self.source.read(_PIECE)
                if not self.left:
                    if self.inflate is not None:
                        raise ValueError("a WARC file ends inside a record")
                    return b""
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(self.left, 16 * _PIECE)
            self.left = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.left, self.inflate = self.inflate.unused_data, None
            if out:
                return out

    def headers(self) -> dict[str, str] | None:
        """The next record's headers; None at the end."""
        self.buffer = self.buffer.lstrip(b"\r\n")
        while not self.buffer:
            piece = self._more()
            if not piece:
                return None
            self.buffer = piece.lstrip(b"\r\n")
        while (cut := self.buffer.find(b"\r\n\r\n")) < 0:
            piece = self._more()
            if not piece:
                raise ValueError("a WARC record has no end of its headers")
            self.buffer += piece
        head, self.buffer = parse_headers(self.buffer[:cut]), self.buffer[cut + 4 :]
        return head

    def take(self, size: int) -> bytes:
        pieces, missing = [self.buffer], size - len(self.buffer)
        while missing > 0:
            piece = self._more()
            if not piece:
                raise ValueError("a WARC file ends inside a record")
            pieces.append(piece)
            missing -= len(piece)
        whole = b"".join(pieces)
        self.buffer = whole[size:]
        return whole[:size]

    def skip(self, size: int) -> None:
        missing = size - len(self.buffer)
        if missing <= 0:
            self.buffer = self.buffer[size:]
            return
        self.buffer = b""
        if not self.packed:
            self.source.seek(self.source.tell() + missing)
            return
        while missing > 0:
            piece = self._more()
            if not piece:
                raise ValueError("a WARC file ends inside a record")
            self.buffer, missing = piece[missing:], missing - len(piece)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("payload", "text")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _HEADER_COLUMNS:
                self.tests.append((f.attribute[0], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        store, root = _storage(self.path)
        infos = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        names = {i.base_name for i in infos if not i.base_name.startswith("_")}
        found = [n for n in sorted(names) if n.endswith((".warc.gz", ".warc"))]
        stem = {n: n.removesuffix(".gz").removesuffix(".warc") + ".idx" for n in found}
        return [WarcFile(posixpath.join(root, n), posixpath.join(root, stem[n]) if stem[n] in names else None) for n in found] or [WarcFile("", None)]

    def _wanted(self, row: dict) -> bool:
        by_name = {k.__name__: t for k, t in _TESTS.items()}
        return all(row[c] is not None and by_name[name](row[c], x) for c, name, x in self.tests)

    def _members(self, source, index, packed: bool):
        """``(headers, rest)`` of each wanted record; ``rest()`` gives what follows the headers."""
        if index is not None:
            for line in index.read().splitlines():
                entry = json.loads(line)
                if self._wanted(entry):
                    source.seek(entry["at"])
                    packed = source.read(entry["size"])
                    yield self._open(packed)
            return
        stream = _Stream(source, packed)
        while head := stream.headers():
            size = int(head["content-length"])
            if self._wanted(_summary(head)):
                block = stream.take(size)
                yield head, lambda b=block: b
            else:
                stream.skip(size)

    @staticmethod
    def _open(packed: bytes):
        inflate = zlib.decompressobj(31)
        begun = inflate.decompress(packed, 2048)
        while (cut := begun.find(b"\r\n\r\n")) < 0:
            if not (more := inflate.decompress(inflate.unconsumed_tail, 2048)):
                raise ValueError("a WARC record has no end of its headers")
            begun += more
        return parse_headers(begun[:cut]), lambda: begun[cut + 4 :] + inflate.decompress(inflate.unconsumed_tail) + inflate.flush()

    def read(self, partition: WarcFile):
        if not partition.path:
            return
        store, _ = _storage(self.path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        rows: list[dict] = []
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        index = store.open_input_stream(partition.index, compression=None) if partition.index else None
        with store.open_input_file(partition.path) as source:
            for head, rest in self._members(source, index, partition.path.endswith(".gz")):
                row = _summary(head)
                http, _, payload = rest()[: int(head["content-length"])].partition(b"\r\n\r\n")
                row["payload_bytes"] = int(parse_headers(http)["content-length"])
                row["payload"] = None
                if row["record_type"] == "response":
                    if len(payload) != row["payload_bytes"] or hashlib.sha1(payload).hexdigest() != row["payload_digest"]:
                        raise ValueError(f"record {head.get('warc-record-id')} doesn't match its digest")
                    if self.content == "text":
                        row["payload"] = payload.decode("utf-8", "replace")
                rows.append(row)
                held += len(payload)
                if held >= 4 << 20 or len(rows) >= 5000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("max_bytes", 256 << 20)))


def register(spark: SparkSession) -> None:
    """Make the source known; filters reach it through a setting that is read when a query is planned, so it stays in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


#: Up to so many repeated payloads are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 1_000_000


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row of ``pages`` to ``path``.

    Payloads are the html in UTF-8, null being empty. Of rows with equal
    payloads of ``REVISIT_BYTES`` or more, the one of largest id is a response
    and the others revisit it; smaller payloads are all responses. Of repeated
    rows (one id) all are alike; rows without an id aren't written; an empty
    table writes no file.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("payload_digest")
    )
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least")).where("least < kept").drop("least")
    if groups.count() <= BROADCAST_DIGESTS:
        groups = F.broadcast(groups)
    rows = rows.join(groups, "payload_digest", "left")
    rows = rows.select("page_id", "url", "payload", "payload_digest", F.when(F.col("page_id") < F.col("kept"), F.col("kept")).alias("refers_to"))
    rows.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: str = "text") -> DataFrame:
    """The records under ``path``; see ``SCHEMA``."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back, payloads checked but not sent on."""
    path = f"{shared_dir(pages.sparkSession)}/spanmill/warc-{uuid.uuid4().hex}"
    archive(pages, path, **columns)
    return read(pages.sparkSession, path, payload="digest").drop("payload")
