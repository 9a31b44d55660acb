"""WARC archives with resolved revisits (operator 8).

Pages become WARC/1.1 records. Headers (id, URL, payload digest, payload size) are grouped by digest and size; of equal
payloads the record with the largest id is the response, the others are revisit records that refer to it. Payloads are never
shuffled by digest: a revisit record is made of its headers alone, and responses are the rows that no revisit takes, of which
only those near a revisit in a filter of bounded size are shuffled at all, by id.

Archives have a gzip member for each record and start with a warcinfo record. A task fills a file of about FILE_BYTES
compressed bytes and hands it over as one value to Spark's writer, so files go to any store, are committed as a whole, and
a lost task writes its files again. An empty gzip member ends a file: it is the writer's line separator. Reading takes each file
through Spark's binary source and inflates member after member; revisits are joined to the responses they refer to.

A null payload is empty, and empty payloads are equal (with `least_bytes` 0). A null URL leaves the target out; line ends
and control characters in URLs are percent-encoded. Of repeated rows with the group's largest id one is the response and the
others revisit it; an id with several payloads is several rows. Ids are whole numbers; null ids come before all
others, and a group of null ids alone has a response without an id, so that `refers_to` of its revisits is null.
Very long payloads are a file by themselves. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.store import filtered, join_groups, row_hash, table

FILE_BYTES = 32 << 20  # compressed bytes after which a file ends
EOL = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE = "factloom"
NAMES = uuid.UUID(int=0x6F1D0C52A3B94E7D8C5B0A9E7F213344)  # ids of records are made in this namespace


def base32_sha1(col: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string in UTF-8: four characters for each five hex digits."""
    hexed, out = F.sha1(col.cast("binary")), []
    for i in range(0, 40, 5):
        n = F.conv(F.substring(hexed, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _payload(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def deduplicated(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload (null: a revisit), payload_bytes, payload_digest, single (no other record with this id and payload is a response), revisits, refers_to (the response's id)."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), _payload(payload_col).alias("payload"))
    p = p.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    heads = table(p.drop("payload"), "heads")
    key = ["payload_digest", "payload_bytes"]
    groups = heads.where(F.col("payload_bytes") >= least_bytes).groupBy(*key).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    several = table(join_groups(heads, table(groups, "groups"), key, "n").drop("n"), "several")
    first = F.col("page_id").eqNullSafe(F.col("first_id"))
    later = several.where(first).groupBy("page_id", *key, "first_id").agg(F.count("*").cast("int").alias("times"), F.max("url").alias("url")).where("times > 1")
    again = later.select("page_id", "url", *key, "first_id", F.explode(F.sequence(F.lit(2), "times")).alias("_"))  # repeated rows of the response's id
    revisits = several.where(~first).select("page_id", "url", *key, "first_id").unionByName(again.drop("_"))
    taken = several.where(~first).select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.lit(False).alias("_stays")).unionByName(later.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.lit(True).alias("_stays"))).distinct()
    taken = table(taken, "taken")
    maybe, others = filtered(p, row_hash(F.col("page_id"), F.col("payload_digest")), taken, row_hash(F.col("_id"), F.col("_digest")))
    judged = maybe.join(taken.hint("merge"), (F.col("payload_digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    responses = others.unionByName(judged.where("_stays is null").select(p.columns)).unionByName(judged.where("_stays").dropDuplicates(["page_id", "payload_digest"]).select(p.columns))
    out = responses.select("page_id", "url", "payload", "payload_bytes", "payload_digest", (F.col("payload_bytes") >= least_bytes).alias("single"), F.lit(False).alias("revisits"), F.lit(None).cast("long").alias("refers_to"))
    return out.unionByName(revisits.select("page_id", "url", F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest", F.lit(False).alias("single"), F.lit(True).alias("revisits"), F.col("first_id").alias("refers_to")))


def _url(url: Column) -> Column:
    for c in "\r\n\t \0\x0b\x0c":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return url


def _name(page_id: int | None, digest: str) -> str:
    """The id of a response that others may refer to: of its page and payload."""
    return uuid.uuid5(NAMES, f"{page_id}|{digest}").urn


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}{EOL}" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, wbits=31)
    return z.compress(f"WARC/1.1{EOL}{head}{EOL}".encode() + block + b"\r\n\r\n") + z.flush()


NOTHING = zlib.compressobj(6, wbits=31).flush()  # an empty gzip member


def _files(date: str, file_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def info(k: int) -> bytes:
            block = f"software: {SOFTWARE}{EOL}format: WARC File Format 1.1{EOL}".encode()
            return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(NAMES, f'info|{date}|{part}|{k}').urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], block)

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

        for batch in batches:
            for page, url, payload, n, digest, single, revisit, refers in zip(*([x.as_py() for x in c] if k != 2 else c for k, c in enumerate(batch.columns)), strict=True):
                number += 1
                if not held:
                    held, size = [info(number)], 0
                # a response that can be referred to has an id that others can know; the rest are told apart by their place
                own = uuid.uuid5(NAMES, f"{page}|{digest}|{part}|{number}").urn if revisit or not single else _name(page, digest)
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date), ("X-Page-ID", "" if page is None else str(page))]
                headers += [("WARC-Target-URI", url)] if url is not None else []
                headers += [("WARC-Payload-Digest", f"sha1:{digest}")]
                if revisit:
                    headers += [("WARC-Refers-To", f"<{_name(refers, digest)}>"), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", "" if refers is None else str(refers))]
                http = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {n}{EOL}{EOL}".encode()
                held.append(_member([*headers, ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload.as_buffer().to_pybytes()))
                size += len(held[-1])
                if size >= file_bytes:
                    yield file()
                    held = []
        if held:
            yield file()

    return work


def write(records: DataFrame, path: str, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Writes records with fresh headers as gzip archives into a new folder; date: of capture, by default now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = records.withColumn("url", _url(F.col("url"))).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "single", "revisits", "refers_to")
    files = own.mapInArrow(_files(date, file_bytes), "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


WINDOW = 1 << 14  # bytes handed to the decompressor at once: what it has not used of them is all that is read twice


def members(raw: memoryview | bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, one after another, in time that is linear in the file."""
    view, at = memoryview(raw), 0
    while at < len(view):
        z, parts = zlib.decompressobj(wbits=31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            window = view[at : at + WINDOW]
            parts.append(z.decompress(window))
            at += len(window) - len(z.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and block, of a record."""
    if not record.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    end = record.index(b"\r\n\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in record[:end].decode().split(EOL)[1:])}
    n = int(head["content-length"])
    if record[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return head, record[end + 4 : end + 4 + n]


COLUMNS = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload string, record_id string, refers_to_record string"
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
BATCH_BYTES = 8 << 20
PER = 4096


def _number(head: dict[str, str], name: str) -> int | None:
    x = head.get(name, "")
    return int(x) if x else None


def _records(with_payload: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=[x.split()[0] for x in COLUMNS.split(", ")])

        for batch in batches:
            for file in batch.column("content"):
                rows, size = [], 0
                for record in members(file.as_buffer()):
                    if not record:
                        continue
                    head, block = parse(record)
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    n, payload = None, None
                    if kind == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"the payload of {head['warc-record-id']} has another digest")
                        n, payload = len(body), body.decode() if with_payload else None
                    rows.append((_number(head, "x-page-id"), head.get("warc-target-uri"), kind, digest, _number(head, "x-refers-to-page-id"), n, payload, head["warc-record-id"], head.get("warc-refers-to")))
                    size += len(record) if with_payload else 300
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return work


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives in a folder: page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload, record_id, refers_to_record.

    Payloads' digests are checked. Revisits get the payload (or only its size) of the response that they refer to.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(_records(with_payload), COLUMNS)
    rows = rows if with_payload else table(rows, "read")
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    revisits, responses = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload"), rows.where("record_type = 'response'")
    wanted = table(revisits.groupBy("refers_to_record").agg(F.count("*").alias("n")), "wanted")
    copies = F.ceil(F.col("n") / PER).cast("int")  # a response is there once for so many of its revisits
    salted = join_groups(revisits, wanted, ["refers_to_record"], "n").withColumn("salt", F.pmod(F.xxhash64("record_id"), copies).cast("int")).drop("n")
    found = responses.select(F.col("record_id").alias("refers_to_record"), "payload_bytes", "payload").join(wanted, "refers_to_record").select("refers_to_record", "payload_bytes", "payload", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    return responses.select(names).unionByName(salted.join(found, ["refers_to_record", "salt"]).select(names))
