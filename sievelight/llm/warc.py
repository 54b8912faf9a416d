"""WARC archives: a writer, and a Python data source that plans file partitions and skips what it is not asked for."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from .common import small_batches, small, spill, shared_dir, table

#: A file is closed when it holds this much, so that a file is a bounded partition for readers.
FILE_BYTES = 32 << 20
#: Files of a manifest that one task reads.
TASK_FILES = 4
#: Shorter payloads are never replaced by a reference.
REVISIT_BYTES = 100
_CRLF = b"\r\n"
# Fixed values of WARC/1.1.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ("record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
          "payload_length long, headers map<string,string>, payload binary")
_HEADER_OF = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
              "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}


def open_at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items() if v is not None), b"Content-Length: %d" % len(block)]
    return _CRLF.join(lines) + _CRLF * 2 + block + _CRLF * 2


def _uri(text: str | None) -> str | None:
    """Characters that end a header line are percent-encoded."""
    return None if text is None else quote(text, safe="".join(map(chr, range(33, 127))) + "".join(c for c in text if ord(c) > 160))


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    common = {"WARC-Record-ID": record_id(page_id), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": _uri(url),
              "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is None:
        return record({"WARC-Type": "response", **common}, head + payload)
    return record({"WARC-Type": "revisit", **common, "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}, head)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _writing(folder: str, compress: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, out, size, n = [], [], None, 0, 0
        where, path = open_at(folder)

        def start():
            nonlocal out, size, n
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc" + ".gz" * compress
            out, size, n = where.open_output_stream(f"{path}/{name}", compression=None), 0, 0
            names.append(f"{folder}/{name}")

        def end():
            nonlocal out
            if out:
                out.close()
                counts.append((n, size))
                out = None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    start()
                data = page_record(*r)
                data = gzip.compress(data, mtime=0) if compress else data
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    end()
        end()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c[0] for c in counts], pa.int64()),
            pa.array([c[1] for c in counts], pa.int64())], ["path", "records", "bytes"])
    return run


def archive(pages: DataFrame, folder: str, compress: bool = False) -> str:
    """Writes a record per row of `pages` to files in a shared folder; returns the folder of their manifest, a table of
    (path, records, bytes).

    Of equal payloads of at least REVISIT_BYTES the smallest page_id is a response and the others revisit it; rows
    that repeat this id are responses too. Null html is an empty payload, a null url leaves the header out, null
    ids are written as empty and never named by a revisit. Files of lost or repeated tasks stay unnamed by the
    manifest and are not read. Payloads of any length are written whole; columns other than page_id, url and html are left
    out, so none can clash. An empty table gives an empty manifest.
    """
    small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    a = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest",
        F.sha2("payload", 256))
    keyed = a.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = spill(keyed.filter("_n > 1").select("digest", "_first"), "warc-copies")
    b = a.join(small(first), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")))
    open_folder, path = open_at(folder)
    open_folder.create_dir(path, recursive=True)
    manifest = f"{folder.rstrip('/')}-manifest"
    b.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_writing(folder, compress),
        "path string, records long, bytes long").write.parquet(manifest)
    return manifest


class Files(InputPartition):
    """Archives by name, or the rows first..end-1 of a part of a manifest, which the task itself reads."""

    def __init__(self, paths: list[str] = (), part: str | None = None, first: int = 0, end: int = 0):
        self.paths, self.part, self.first, self.end = list(paths), part, first, end

    def names(self) -> list[str]:
        if self.part is None:
            return self.paths
        where, path = open_at(self.part)
        with where.open_input_file(path) as f:
            return pq.read_table(f, columns=["path"]).slice(self.first, self.end - self.first).column("path").to_pylist()


def _listed(folder: str, *ends: str) -> list[str]:
    where, path = open_at(folder)
    scheme = folder.split("://")[0] if "://" in folder else "file"
    found = [f for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(ends)]
    return [f"{scheme}://{f.path}" for f in sorted(found, key=lambda f: f.path)]


class WarcReader(DataSourceReader):
    """Options: manifest (folder of the table that `archive` returns) or path (a folder of archives); payload = false leaves
    payloads undecoded. Archives of a manifest are never listed on the driver, which sees its parts and their row counts."""

    def __init__(self, options: dict):
        self.manifest, self.path = options.get("manifest"), options.get("path")
        self.with_payload = options.get("payload", "true") != "false"
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes tests of record type and headers; they are made before a payload is read."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADER_OF and isinstance(f, EqualTo):
                self.wanted.append((name, "in", {f.value}))
            elif name in _HEADER_OF and isinstance(f, In):
                self.wanted.append((name, "in", set(f.value)))
            elif name in _HEADER_OF and isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", f.value))
            elif name in _HEADER_OF and isinstance(f, IsNotNull):
                self.wanted.append((name, "some", None))
            else:
                yield f

    def partitions(self):
        if self.manifest is None:
            return [Files([p]) for p in _listed(self.path, ".warc", ".warc.gz")] or [Files()]
        out = []
        for part in _listed(self.manifest, ".parquet"):
            where, path = open_at(part)
            with where.open_input_file(path) as f:
                n = pq.read_metadata(f).num_rows
            out += [Files(part=part, first=i, end=min(n, i + TASK_FILES)) for i in range(0, n, TASK_FILES)]
        return out or [Files()]

    def _wants(self, head: dict[str, str]) -> bool:
        for name, how, value in self.wanted:
            got = head.get(_HEADER_OF[name].lower())
            got = got.removeprefix("sha256:") if got and name == "payload_digest" else got
            if got is None or how == "in" and got not in value or how == "starts" and not got.startswith(value):
                return False
        return True

    def read(self, partition: Files):
        for p in partition.names():
            where, path = open_at(p)
            with where.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if p.endswith(".gz") else raw
                yield from self._records(stream)

    def _records(self, stream) -> Iterator[tuple]:
        buffer = b""
        at = 0  # of the stream, where the buffer ends
        while True:
            while (cut := buffer.find(_CRLF * 2)) < 0:
                more = stream.read(1 << 16)
                if not more:
                    if buffer.strip():
                        raise ValueError(f"a WARC record header ends early, {len(buffer)} bytes before the end of the file")
                    return
                buffer += more
                at += len(more)
                buffer = buffer.lstrip(b"\r\n") if not buffer.startswith(VERSION[:5]) else buffer
            lines = buffer[:cut].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length, buffer = int(head["content-length"]), buffer[cut + 4:]
            total = length + 4
            wanted, block = self._wants(head), b""
            # a wanted record's HTTP header is read; its payload only if asked for
            need = total if wanted and self.with_payload and head.get("warc-type") == "response" else 0
            while len(buffer) < need or wanted and not need and (block := buffer[:length]).find(_CRLF * 2) < 0 and len(buffer) < total:
                more = stream.read(max(need - len(buffer), 1 << 12) if need else min(1 << 12, total - len(buffer)))
                if not more:
                    break
                at += len(more)
                buffer += more
            block = buffer[:length]
            if len(buffer) >= total:
                buffer = buffer[total:]
            else:  # the payload is neither read nor decoded
                at += total - len(buffer)
                stream.seek(at)
                buffer = b""
            if wanted:
                http, _, payload = block.partition(_CRLF * 2)
                yield self._row(head, http, payload if need else None)

    def _row(self, head: dict[str, str], http: bytes, payload: bytes | None) -> tuple:
        digest = head.get("warc-payload-digest")
        # a revisit repeats the header of the response that it stands for, and with it the payload's length
        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(_CRLF)) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
        return (head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), digest and digest.removeprefix("sha256:"),
                head.get("warc-refers-to"), length, head, payload)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sievelight_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, folder: str, payload: bool = True, manifest: bool = False) -> DataFrame:
    """Records of the WARC files of a folder, or of those that a written manifest names. Filters on record_type and header
    columns are pushed to the reader. The session must allow push-down to Python sources: see `pushing`."""
    spark.dataSource.register(WarcSource)
    r = spark.read.format("sievelight_warc").option("payload", str(payload).lower())
    return r.option("manifest", folder).load() if manifest else r.load(folder)


def pushing(spark: SparkSession) -> None:
    """Lets Spark hand filters to Python data sources. The setting is read when a query is planned, so it stays on."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pushing(spark)
    manifest = archive(table(spark, sf_dir, "pages"), f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    page = lambda c: F.when(F.col(c) != "<urn:page:>", F.regexp_extract(c, "^<urn:page:(.*)>$", 1)).cast("long")
    # one pass over the archives: a response's length and digest are those of what was read, a revisit's those of its headers
    got = read(spark, manifest, manifest=True).filter(F.col("record_type").isin("response", "revisit"))
    return got.select(page("record_id").alias("page_id"), F.coalesce(F.octet_length("payload"),
        F.col("payload_length")).cast("long").alias("payload_bytes"),
                      F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"), "record_type",
                      page("refers_to").alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
