"""WARC archives from a chunked record table.

A payload travels as rows (record, chunk number, chunk) of at most `chunk_bytes`, so neither writer nor reader holds a whole
record: the writer compresses chunk after chunk into the record's own gzip member while it carries the SHA-1 of what it has
seen, and the reader streams the member back the same way. Length and digest that the header needs come from a first pass
over the table.

Of records with equal payloads of at least `least_bytes`, the one with the smallest id is a `response`; the others are
`revisit` records that carry no payload and refer to it. Which is which is settled on rows of (id, digest, length) alone;
the groups are pre-aggregated, and payloads are shuffled once, by record, so a payload that a third of all pages share is
not gathered anywhere.

Archives (one .warc.gz for each task, started anew beyond `file_bytes`) go to the shared folder under names of their own and
are renamed when whole; a lost or repeated task leaves the same file again.

Defined cases: null html is an empty payload; a null id sorts after all others, and such a record is named by its digest
alone; rows with equal id and payload give one response and revisits to it (below least_bytes, responses); a null url is left
out; without rows there are no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.llm._common import bounded_batches, materialised, open_filesystem, publish, shared_dir, table

CHUNK_BYTES = 1 << 18
FILE_BYTES = 1 << 30
LEVEL = 2
READ_BYTES = 1 << 18
#: Every record carries one date, so that the same table gives the same archives.
DATE = "2000-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# the chunked record table -----------------------------------------------------------------------------------------------


def payload_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    return rows.select("id", "url", "payload", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n_bytes"))


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk of a payload; an empty payload has one empty chunk."""
    last = F.greatest(F.lit(0), F.floor((F.col("n_bytes") - 1) / chunk_bytes)).cast("int")
    parts = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return parts.withColumn("chunk", F.when(F.col("n_bytes") <= chunk_bytes, F.col("payload")).otherwise(F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))).drop("payload")


def roles(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(id, url, sha1, n_bytes, place, first_id, is_response) of every record, without payloads.

    place counts the records of one id and payload; only those share it.
    """
    facts = materialised(rows.select("id", "url", "sha1", "n_bytes"), "record-facts")
    each = facts.groupBy("id", "url", "sha1", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("sha1").agg(F.min("id").alias("first_id"), F.min(F.when(F.col("id").isNull(), F.struct(F.coalesce("url", F.lit(""))))).alias("_null_first"))
    keys = each.groupBy("id", "sha1").agg(F.min(F.coalesce("url", F.lit(""))).alias("_first_url"))
    joined = each.join(first, "sha1").join(keys.select(F.col("id").alias("_id"), F.col("sha1").alias("_sha1"), "_first_url"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")))
    joined = joined.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    leads = F.col("id").eqNullSafe(F.col("first_id")) & (F.coalesce("url", F.lit("")) == F.col("_first_url")) & (F.col("place") == 1)
    return joined.withColumn("is_response", leads | (F.col("n_bytes") < least_bytes)).select("id", "url", "sha1", "n_bytes", "place", "first_id", "is_response")


def record_table(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int, chunk_bytes: int) -> DataFrame:
    """Chunk rows of responses and single rows of revisits, a record's rows together and in order within their partition."""
    rows = payload_rows(pages, id_col, url_col, html_col)
    known = materialised(roles(rows, least_bytes), "record-roles")
    key = [F.col("id").alias("_id"), F.col("sha1").alias("_sha1"), F.coalesce("url", F.lit("")).alias("_url")]
    answers = known.groupBy(*key).agg(F.count_if("is_response").alias("answers"), F.count(F.lit(1)).alias("copies")).where("answers > 0")
    sent = chunked(rows, chunk_bytes).join(answers, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")) & (F.coalesce("url", F.lit("")) == F.col("_url")))
    columns = ["id", "url", "sha1", "n_bytes", "chunk_no", "chunk", "answers", "refers_to", "is_response"]
    sent = sent.withColumns({"refers_to": F.lit(None).cast("long"), "is_response": F.lit(True)})
    once = sent.where("copies = 1").select(columns).sortWithinPartitions("id", "sha1", "url", "chunk_no")
    if not known.where("place > 1").isEmpty():  # equal rows: one of each stays, by partial aggregation before the shuffle
        equal = sent.where("copies > 1").select(columns).dropDuplicates(["id", "url", "sha1", "chunk_no"])
        once = once.union(equal.repartition("id", "url", "sha1").sortWithinPartitions("id", "sha1", "url", "chunk_no").select(columns))
    back = known.where("NOT is_response").select("id", "url", "sha1", "n_bytes", F.lit(0).alias("chunk_no"), F.lit(None).cast("binary").alias("chunk"), F.lit(1).cast("long").alias("answers"), F.col("first_id").alias("refers_to"), "is_response")
    return once.union(back.select(columns))


# records ----------------------------------------------------------------------------------------------------------------


def record_id(name: int | None, digest: str) -> str:
    return f"<urn:page:{'' if name is None else name}:{digest}>"


def headers(kind: str, name: int | None, url: str | None, digest: str, refers_to: int | None, http: bytes, n_block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(name, digest)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {n_block}"]
    return "\r\n".join([*lines, "", ""]).encode() + http


class Writer:
    """Records into one archive at a time, each record a gzip member."""

    def __init__(self, out):
        self.out, self.records = out, 0

    def begin(self, kind: str, name: int | None, url: str | None, sha1: str, n_bytes: int, refers_to: int | None = None) -> None:
        self.expected = sha1
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        self.packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        block = len(http) + (n_bytes if kind == "response" else 0)
        self.out.write(self.packer.compress(headers(kind, name, url, base32(bytes.fromhex(sha1)), refers_to, http, block)))
        self.digest = hashlib.sha1() if kind == "response" else None

    def chunk(self, data: bytes) -> None:
        self.digest.update(data)
        self.out.write(self.packer.compress(data))

    def end(self) -> None:
        if self.digest and self.digest.hexdigest() != self.expected:
            raise ValueError("payload differs from its digest")
        self.out.write(self.packer.compress(b"\r\n\r\n") + self.packer.flush())
        self.records += 1


def archive(rows: Iterator[tuple], out, file_bytes: int) -> tuple[int, tuple | None]:
    """Writes rows until they end or the archive is full; gives (records, the row that begins the next archive)."""
    writer, key = Writer(out), None
    for row in rows:
        name, url, sha1, n_bytes, chunk_no, chunk, answers, refers_to, is_response = row
        if (name, url, sha1, is_response) != key or not is_response:
            if key and key[3]:
                writer.end()
            key = None
            if out.tell() >= file_bytes:
                return writer.records, row
            key = (name, url, sha1, is_response)
            if not is_response:
                writer.begin("revisit", name, url, sha1, n_bytes, refers_to)
                writer.end()
                continue
            if chunk_no == 0 and answers > 1 and n_bytes <= len(chunk):  # equal small rows that are all responses
                for _ in range(answers - 1):
                    writer.begin("response", name, url, sha1, n_bytes)
                    writer.chunk(chunk)
                    writer.end()
            writer.begin("response", name, url, sha1, n_bytes)
        writer.chunk(chunk)
    if key and key[3]:
        writer.end()
    return writer.records, None


def write_archives(pages: DataFrame, directory: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> list[str]:
    """Writes pages as archives below directory; gives their file names."""
    if least_bytes > chunk_bytes:
        raise ValueError("least_bytes may not exceed chunk_bytes")
    bounded_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        filesystem, root = open_filesystem(directory)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        head = next(rows, None)
        while head is not None:
            name, made, source = f"part-{part:08d}-{number:05d}.warc.gz", [], chain([head], rows)
            publish(filesystem, f"{root}/{name}", lambda out, source=source, made=made: made.append(archive(source, out, file_bytes)))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([made[0][0]], pa.int64())], names=["file", "records"])
            head, number = made[0][1], number + 1

    written = materialised(record_table(pages, id_col, url_col, html_col, least_bytes, chunk_bytes).mapInArrow(write, "file string, records long"), "archives")
    return [r["file"] for r in written.select("file").orderBy("file").collect()]


# reading ----------------------------------------------------------------------------------------------------------------


class Stream:
    """Plain bytes of an archive, gzip member by gzip member, never more than asked for and one read."""

    def __init__(self, file):
        self.file, self.raw, self.plain = file, b"", b""
        self.unpacker = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(READ_BYTES)
                if not self.raw:
                    return False
            if self.unpacker.eof:
                self.unpacker = zlib.decompressobj(31)
            got = self.unpacker.decompress(self.raw, READ_BYTES)
            self.raw = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if got:
                self.plain += got
                return True

    def head(self) -> dict[str, str] | None:
        """Header fields up to the blank line; None at the end."""
        while b"\r\n\r\n" not in self.plain:
            if not self.more():
                return None
        text, _, self.plain = self.plain.partition(b"\r\n\r\n")
        return dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.more():
                raise ValueError("archive ends within a record")
            part, self.plain = self.plain[:n], self.plain[n:]
            n -= len(part)
            yield part


def records(file) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """(id, payload bytes, payload digest, type, referred id) of every record; payloads are checked as they stream by."""

    def named(urn: str) -> int | None:
        name = urn.split(":")[2]
        return int(name) if name else None

    stream = Stream(file)
    while (head := stream.head()) is not None:
        http = stream.head()
        n, kind, stated = int(http["Content-Length"]), head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response":
            digest = hashlib.sha1()
            for part in stream.take(n):
                digest.update(part)
            if base32(digest.digest()) != stated:
                raise ValueError(f"{head['WARC-Record-ID']}: payload differs from its digest")
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError(f"{head['WARC-Record-ID']}: no end of record")
        yield named(head["WARC-Record-ID"]), n, stated, kind, named(head["WARC-Refers-To"]) if kind == "revisit" else None


def read_archives(spark: SparkSession, directory: str, files: list[str]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; one task an archive."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                filesystem, root = open_filesystem(directory)
                with filesystem.open_input_stream(f"{root}/{files[k]}", compression=None) as file:
                    rows = []
                    for row in records(file):
                        rows.append(row)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives."""
    directory = shared_dir(spark, "warc")
    return read_archives(spark, directory, write_archives(table(spark, sf_dir, "pages"), directory))
