"""WARC archives: writing, reading back, and resolving revisits.

Archives are real files of the shared folder, written by Spark's text writer: a row is a
run of whole records of bounded size, a file holds one row, and the writer's line
separator is the two line ends that close a record.  They are read back as whole files of
bounded size and parsed by Content-Length, so no byte of a payload can end a record.

``resolve`` shuffles headers only: the winner of each payload digest is a pre-aggregated
maximum, joined back to the headers, and the decisions go back to the archives by file.
``rewrite`` then writes new archives in which a revisit has no payload but refers to the
response's record, all with fresh headers.

Defined results: a null payload is empty; a record that repeats page and payload is
answered by one response, its other copies revisit it; a null page is written without an id
and sorts below every other; an empty table gives no archives and no rows; only the page's
key, address and payload are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches

END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in one archive before packing (a single larger record gets its own), and the fixed date of a run.
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, serial: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{serial}')}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _address(url: str | None) -> str:
    """An address that stays in its header line."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record; names are lower-cased."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = split + 4
        end = begin + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't closed")
        yield at, headers, data[begin:end]
        at = end + 4


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _packed(records: Iterator[bytes]) -> Iterator[bytes]:
    """Runs of records of about ARCHIVE_BYTES, as the writer's rows."""
    held, size = [], 0
    for r in records:
        if held and size + len(r) > ARCHIVE_BYTES:
            yield END.encode().join(held)
            held, size = [], 0
        held.append(r)
        size += len(r) + len(END)
    if held:
        yield END.encode().join(held)


def _rows(runs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for run in runs:
        yield pa.RecordBatch.from_arrays([pa.array([run], pa.binary()).cast(pa.string())], ["value"])


def _save(archives: DataFrame, path: str, level: str = "DEFAULT_COMPRESSION") -> None:
    """A file per row, packed; the separator after a row closes its last record."""
    archives.write.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", level).text(path)


def write(rows: DataFrame, page: str, url: str, payload: str, path: str, level: str = "DEFAULT_COMPRESSION") -> None:
    """A response record per row of ``rows``, in archives under ``path``; ``level`` is Hadoop's name of a gzip level: BEST_SPEED suits archives that are soon read and dropped."""
    small_batches(rows.sparkSession)

    def run(batches):
        def records():
            for batch in batches:
                for key, address, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    body = body or b""
                    sha = digest(body)
                    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(key, sha)), ("WARC-Date", DATE), ("WARC-Target-URI", _address(address))]
                    if key is not None:
                        fields.append(("X-Page-ID", str(key)))
                    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
                    yield record(fields, HTTP + body)

        return _rows(_packed(records()))

    _save(rows.select(F.col(page).cast("long"), F.col(url).cast("string"), F.col(payload).cast("string")).mapInArrow(run, "value string"), path, level)


def _files(spark: SparkSession, path: str) -> DataFrame:
    small_batches(spark)  # a file is a row, and larger than a batch should be
    return spark.read.format("binaryFile").load(path).select("path", "content")


HEADERS = "file string, offset long, page_id long, url string, record_id string, record_type string, refers_to_id string, payload_digest string, payload_bytes long"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``: its header fields, and the size of the payload that it holds (null for a revisit)."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, h, block in parse(gzip.decompress(content.as_py())):
                    kind = h["warc-type"]
                    payload = payload_of(block)
                    stated = h["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != stated:
                        raise ValueError(f"{file}, byte {at}: the payload doesn't match its digest")
                    page = h.get("x-page-id")
                    rows.append((file, at, None if page is None else int(page), h["warc-target-uri"], h["warc-record-id"], kind, h.get("warc-refers-to"), stated, None if kind == "revisit" else len(payload)))
                if not rows:  # an empty part of the writer
                    continue
                columns = list(zip(*rows, strict=True))
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in HEADERS.split(", ")])

    return _files(spark, path).mapInArrow(run, HEADERS)


def _place() -> Column:
    """The order of equal payloads: the largest page wins, then the first place in the archives."""
    return F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), F.lit(0) - F.col("offset"), "file")


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers with decision (response or revisit) and refers (page and record id of the response); small payloads are always responses."""
    large = F.col("payload_bytes") >= min_bytes
    winners = headers.where(large).groupBy("payload_digest").agg(F.max_by(F.struct("page_id", "record_id", "file", "offset", "url"), _place()).alias("w"))
    joined = headers.join(winners, "payload_digest", "left")
    own = F.col("w").isNull() | ~large | ((F.col("w.file") == F.col("file")) & (F.col("w.offset") == F.col("offset")))
    return joined.withColumn("decision", F.when(own, "response").otherwise("revisit")).withColumn("refers", F.when(~own, F.struct("w.page_id", "w.record_id", "w.url")))


def rewrite(spark: SparkSession, source: str, decisions: DataFrame, target: str, level: str = "DEFAULT_COMPRESSION") -> None:
    """New archives of the records under ``source``: responses as they are, revisits without payload, all with fresh headers; ``level`` as in ``write``.

    Decisions meet an archive by its file name: lists are as long as an archive, which is bounded.
    """

    def run(batches):
        def records():
            for batch in batches:
                for content, listed in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    by_offset = {d["offset"]: d for d in listed}
                    for at, h, block in parse(gzip.decompress(content.as_py())):
                        d = by_offset[at]
                        again = d["decision"] == "revisit"
                        fields = [("WARC-Type", d["decision"]), ("WARC-Record-ID", record_id(d["page_id"], f"{d['decision']}/{d['offset']}") if again else h["warc-record-id"]), ("WARC-Date", DATE), ("WARC-Target-URI", h["warc-target-uri"])]
                        if d["page_id"] is not None:
                            fields.append(("X-Page-ID", str(d["page_id"])))
                        fields.append(("WARC-Payload-Digest", h["warc-payload-digest"]))
                        if again:
                            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", d["refers"]["record_id"]), ("WARC-Refers-To-Target-URI", d["refers"]["url"]), ("WARC-Refers-To-Date", DATE)]
                            if d["refers"]["page_id"] is not None:
                                fields.append(("X-Refers-To-Page-ID", str(d["refers"]["page_id"])))
                            block = HTTP
                        fields.append(("Content-Type", "application/http; msgtype=response"))
                        yield record(fields, block)

        return _rows(_packed(records()))

    listed = decisions.groupBy("file").agg(F.collect_list(F.struct("offset", "page_id", "decision", "refers")).alias("listed"))
    joined = _files(spark, source).join(listed.withColumnRenamed("file", "path"), "path").select("content", "listed")
    _save(joined.mapInArrow(run, "value string"), target, level)


def follow(headers: DataFrame) -> DataFrame:
    """Revisit records of read-back headers joined to their responses by digest: payload size and page of the response."""
    responses = headers.where("record_type = 'response'").groupBy("record_id").agg(F.max("payload_bytes").alias("found_bytes"), F.max("page_id").alias("refers_to"))
    revisits = headers.where("record_type = 'revisit'")
    # of a revisit the record that it names; one row per record id, so a much-cited response is one row, and the join's skew is split
    followed = revisits.drop("payload_bytes").join(responses.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return headers.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).union(followed.withColumnRenamed("found_bytes", "payload_bytes").select(columns))
