"""WARC archives as a Spark data source, and page archives with revisit records.

Reading plans one partition for each split of a file (the writer leaves a list of split points
beside a file; a file without one is read whole). A reader parses the header lines of a record
first, tests the pushed predicates on them, and passes over the block of a record that is not
wanted, or of every record with the option ``payload=false``, without decoding it. Plain files are
skipped by seeking; in ``.warc.gz`` each record is a gzip member of its own.

Predicates reach the reader when ``spark.sql.python.filterPushdown.enabled`` is set; equality and
IN on the header columns and a prefix of ``target_uri`` are tested there, the rest by Spark.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from soundquay.llm.tables import Staged

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary"
)
#: Header names by column, in the order they are written.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
_COLUMN = {name.lower(): column for column, name in HEADERS.items()}
_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_BATCH_BYTES = 4 << 20
_SPLIT_BYTES = 16 << 20
_READ_BYTES = 1 << 20


class Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def _place(path: str):
    return pafs.FileSystem.from_uri(path)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):  # noqa: N802  the name is Spark's
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            header = column in HEADERS and column != "payload_bytes"
            if header and isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif header and isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif column == "target_uri" and isinstance(f, StringStartsWith):
                self.wanted.append((column, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self):
        store, root = _place(self.path)
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        sizes = {x.path: x.size for x in found if x.is_file}
        splits = []
        for path in sorted(p for p in sizes if p.endswith((".warc", ".warc.gz"))):
            starts = [0]
            if f"{path}.splits" in sizes:
                with store.open_input_stream(f"{path}.splits") as f:
                    starts = json.loads(f.read())
            for at, stop in zip(starts, [*starts[1:], None], strict=True):
                splits.append(Split(path, at, stop))
        return splits or [Split("", 0, 0)]

    def _wants(self, head: dict) -> bool:
        for column, kind, values in self.wanted:
            value = head.get(column)
            if value is None or (kind == "in" and value not in values):
                return False
            if kind == "prefix" and not value.startswith(values):
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        store, _ = _place(self.path)
        columns: dict[str, list] = {}
        held = 0
        with store.open_input_file(partition.path) as raw:
            for head, take in records(raw, partition):
                if not self._wants(head):
                    continue
                payload = take() if self.payload else None
                for column in HEADERS:
                    columns.setdefault(column, []).append(head.get(column))
                columns.setdefault("payload", []).append(payload)
                held += 500 + len(payload or b"")
                if held >= _BATCH_BYTES:
                    yield _batch(columns)
                    columns, held = {}, 0
        if columns:
            yield _batch(columns)


def _batch(columns: dict) -> pa.RecordBatch:
    kinds = {c: pa.string() for c in HEADERS} | {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in kinds.items()], names=[*kinds])


class _Bytes:
    """A window of a file as a stream: reads ahead in large pieces, seeks over long gaps."""

    def __init__(self, raw, start: int, stop: int):
        self.raw, self.at, self.stop, self.ahead = raw, start, stop, b""
        raw.seek(start)

    def read(self, n: int) -> bytes:
        while len(self.ahead) < n and (more := self.raw.read(min(_READ_BYTES, self.stop - self.at))):
            self.at += len(more)
            self.ahead += more
        out, self.ahead = self.ahead[:n], self.ahead[n:]
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.ahead):
            self.ahead = self.ahead[n:]
        else:
            self.at += n - len(self.ahead)
            self.ahead = b""
            self.raw.seek(self.at)

    def readline(self) -> bytes:
        while (end := self.ahead.find(b"\n")) < 0 and (
            more := self.raw.read(min(_READ_BYTES, self.stop - self.at))
        ):
            self.at += len(more)
            self.ahead += more
        return self.read(end + 1 if end >= 0 else len(self.ahead))


class _Zipped:
    """The same for gzip members."""

    def __init__(self, raw, start: int, stop: int):
        raw.seek(start)
        self.inner = io.BufferedReader(gzip.GzipFile(fileobj=_Limited(raw, stop)), _READ_BYTES)
        self.read, self.readline = self.inner.read, self.inner.readline

    def skip(self, n: int) -> None:
        while n > 0 and (got := len(self.inner.read(min(n, _READ_BYTES)))):
            n -= got


class _Limited(io.RawIOBase):
    def __init__(self, raw, stop: int):
        self.raw, self.stop = raw, stop

    def readable(self):
        return True

    def read(self, n=-1):
        left = self.stop - self.raw.tell()
        return self.raw.read(left if n < 0 else min(n, left))


def records(raw, part: Split):
    """Pairs of the header values and a function that reads the payload; not reading it skips it."""
    stop = raw.size() if part.stop is None else part.stop
    stream = (_Zipped if part.path.endswith(".gz") else _Bytes)(raw, part.start, stop)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{part.path}: no WARC record at {line[:40]!r}")
        head, length, http = {}, 0, False
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name in _COLUMN:
                head[_COLUMN[name]] = value
            elif name == "content-length":
                length = int(value)
            elif name == "content-type":
                http = value.startswith("application/http")
        if "payload_digest" in head:
            head["payload_digest"] = head["payload_digest"].removeprefix("sha256:")
        if "payload_bytes" in head:
            head["payload_bytes"] = int(head["payload_bytes"])
        left = [length]

        def take(left=left, http=http):
            block, left[0] = stream.read(left[0]), 0
            return block.partition(b"\r\n\r\n")[2] if http else block

        yield head, take
        stream.skip(left[0])


def _line(name: str, value) -> bytes:
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {text}\r\n".encode()


def record(values: dict) -> bytes:
    """One record; the block is an HTTP head and, but for revisits, the payload."""
    payload = values.get("payload") or b""
    block = _HTTP_HEAD + (b"" if values["record_type"] == "revisit" else payload)
    out = [b"WARC/1.1\r\n"]
    for column, name in HEADERS.items():
        value = values.get(column)
        if value is not None:
            out.append(_line(name, f"sha256:{value}" if column == "payload_digest" else value))
    if values["record_type"] == "revisit":
        out.append(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    out.append(b"Content-Type: application/http; msgtype=response\r\n")
    out.append(_line("Content-Length", len(block)))
    return b"".join([*out, b"\r\n", block, b"\r\n\r\n"])


class WarcWriter(DataSourceArrowWriter):
    """Writes each task to a file of its own name; the commit lets readers see the files."""

    def __init__(self, options):
        self.path = options["path"]
        self.zipped = options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped
        at, splits = 0, [0]
        with store.open_output_stream(f"{root}/{name}.open") as out:
            for batch in iterator:
                for values in batch.to_pylist():
                    data = record(values)
                    data = gzip.compress(data, 1, mtime=0) if self.zipped else data
                    if at - splits[-1] >= _SPLIT_BYTES:
                        splits.append(at)
                    out.write(data)
                    at += len(data)
        if not at:
            store.delete_file(f"{root}/{name}.open")
            return Written([])
        with store.open_output_stream(f"{root}/{name}.splits") as out:
            out.write(json.dumps(splits).encode())
        return Written([name])

    def commit(self, messages):
        store, root = _place(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{root}/{name}.open", f"{root}/{name}")

    def abort(self, messages):
        store, root = _place(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.delete_file(f"{root}/{name}.open")


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to a session and let it push predicates to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


LEAST_REVISIT_BYTES = 100


def page_records(pages: DataFrame) -> DataFrame:
    """One record per page, with the payload html in UTF-8 (null: empty).

    Of equal payloads of at least 100 bytes, the one with the smallest page_id is a response and
    the others revisit it; rows that repeat that page_id with that payload are responses too. A
    null page_id counts as the largest. Only digests with a copy take part in the join.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"),
        html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"),
    )
    firsts = (
        rows.filter(F.col("payload_bytes") >= LEAST_REVISIT_BYTES)
        .groupBy(F.col("payload_digest").alias("same"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    #: small payloads meet nothing: keys of their own keep them out of one hot partition
    own = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    same = F.when(F.col("payload_bytes") >= LEAST_REVISIT_BYTES, F.col("payload_digest")).otherwise(own)
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))

    def name(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))

    return (
        rows.withColumn("same", same)
        .join(firsts, "same", "left")
        .select(
            F.when(later, "revisit").otherwise("response").alias("record_type"),
            name("page_id").alias("record_id"),
            "target_uri",
            F.lit("2024-01-01T00:00:00Z").alias("date"),
            "payload_digest",
            "payload_bytes",
            F.when(later, name("first")).alias("refers_to"),
            F.when(~later, F.col("payload")).alias("payload"),
        )
    )


def write(records_: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records_.sparkSession)
    records_.write.format("warc").option("compression", compression).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_report(pages: DataFrame) -> DataFrame:
    """Archive the pages, read the archives back, and say what each page became.

    Responses are read with their payloads and measured anew; revisits are read from their headers
    alone. One row per page row; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = Staged(spark, "warc").path("archive")
    write(page_records(pages), path)

    def page(c):
        return F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")

    responses = read(spark, path).filter("record_type = 'response'").select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = read(spark, path, payload=False).filter("record_type = 'revisit'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)
