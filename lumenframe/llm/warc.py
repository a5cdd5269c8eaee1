"""WARC archives of pages: repeated payloads become revisit records, and revisits are resolved to their responses."""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import _bitmap, join_hot, map_arrow, stage, stage_dir

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 1000
#: Records are joined to chunks that end with the record at which they reach so many bytes; chunks in one file.
CHUNK_BYTES, CHUNKS_PER_FILE = 8 << 20, 4
#: Fixed values of the format.
VERSION, LINE = b"WARC/1.1", b"\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An extension field that holds the page's id.
PAGE_ID = b"Page-ID"

HEADS = "record_type string, record_id string, page_id long, target_uri string, date string, payload_digest string, payload_bytes long, refers_to_id string"


def record_id(page_id: int | None, digest: str) -> bytes:
    """The name of a page's record: of an id and a digest always the same one."""
    return b"<" + uuid.UUID(bytes=hashlib.sha256(f"{page_id} {digest}".encode()).digest()[:16], version=5).urn.encode() + b">"


def _uri(url: str) -> bytes:
    """A URL as one header value: white space and control characters are percent-encoded."""
    if url.isprintable() and " " not in url:
        return url.encode()
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url).encode()


def _record(kind: str, page_id: int | None, url: str | None, digest: str, n_bytes: int, payload: bytes, origin: tuple[int | None, str | None] | None, date: bytes) -> list[bytes]:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    lines = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + record_id(page_id, digest), b"WARC-Date: " + date]
    lines += [b"WARC-Target-URI: " + _uri(url)] if url else []
    lines += [b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest))]
    if origin:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + record_id(origin[0], digest), b"WARC-Refers-To-Date: " + date]
        lines += [b"WARC-Refers-To-Target-URI: " + _uri(origin[1])] if origin[1] else []
    lines += [PAGE_ID + b": %d" % page_id] if page_id is not None else []
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % (len(http) + len(payload))]
    return [LINE.join(lines), LINE * 2, http, payload, LINE * 2]


def _chunks(date: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:  # the writer ends each chunk with a line end, so the last one is left to it
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[: -len(LINE)]], pa.binary()).cast(pa.string())], ["chunk"])

        for b in batches:
            names, payloads = b.select(["record_type", "page_id", "url", "payload_digest", "payload_bytes", "origin_id", "origin_url"]), b["payload"]
            for i, r in enumerate(names.to_pylist()):
                payload = (payloads[i].as_py() or "").encode()
                origin = (r["origin_id"], r["origin_url"]) if r["record_type"] == "revisit" else None
                parts = _record(r["record_type"], r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"], payload, origin, date)
                held += parts
                size += sum(map(len, parts))
                if size >= CHUNK_BYTES:
                    yield full()
                    held.clear()
                    size = 0
        if held:
            yield full()

    return run


def new_folder(spark: SparkSession) -> str:
    """A fresh place for archives in the shared folder."""
    return f"{stage_dir(spark)}/archives-{uuid.uuid4().hex}"


#: Payloads are equal if these are: the digest, the length and a second hash.
_SAME = ["payload_digest", "payload_bytes", "second_hash"]


def _without(rows: DataFrame, heads: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (payloads and all) without those whose key and id are in ``gone``; next to none of them is shuffled.

    A broadcast bitmap of ``gone`` clears most rows. Which of ``heads``, the same rows without payloads, it takes for
    gone by mistake is found out exactly, and a second bitmap of these lets all others go.
    """
    keys = ["id_hash", *_SAME]
    first, maybe = _bitmap(gone, "id_hash", 1 << 27)
    wrong = stage(heads.join(F.broadcast(first)).where(maybe).select(keys).join(gone, keys, "left_anti"), "warc-kept")
    second, kept = _bitmap(wrong, "id_hash", 1 << 27)
    marked = rows.join(F.broadcast(first)).withColumn("maybe", maybe).drop("_bits")
    clear, rest = marked.where("NOT maybe").drop("maybe"), marked.where("maybe").drop("maybe")
    return clear.unionByName(rest.join(F.broadcast(second)).where(kept).drop("_bits").join(gone.select(keys), keys, "left_anti").select(clear.columns))


def write_archives(pages: DataFrame, where: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, date: str | None = None) -> None:
    """Writes a WARC record for each row into files below ``where``: one response for each repeated payload, and revisits.

    Of rows with equal payloads of ``least_bytes`` or more that with the largest id is the response; the others become
    revisit records that name it, with the HTTP header and without a payload. Only headers are shuffled, by payload
    digest; the largest id of each digest is found by partial maxima, so a payload that a third of all rows share is no
    large group. Spark's writer commits the files, each of at most ``CHUNKS_PER_FILE`` chunks of about ``CHUNK_BYTES``,
    or of a longer record; a lost executor leaves none behind that are read.

    A null payload is empty; a null or empty URL leaves its header out. A row without an id has none in its record and
    is a response only where no row with an id has its payload. Rows that repeat an id and a payload are the same record,
    written as often as they occur, all responses or all revisits. An empty table leaves a folder without records.
    Columns other than the three named, whatever their names, are not read.
    """
    stamp = (date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).encode()
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long"), "second_hash": F.xxhash64("payload")})
    rows = rows.withColumn("id_hash", F.xxhash64("page_id", *_SAME))
    heads = stage(rows.drop("payload"), "warc-heads")
    repeated = heads.where(F.col("payload_bytes") >= least_bytes).groupBy(*_SAME).agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("origin"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.where("n > 1 AND origin IS NOT NULL").select(*_SAME, F.col("origin.page_id").alias("origin_id"), F.col("origin.url").alias("origin_url"))
    others = ~F.col("page_id").eqNullSafe(F.col("origin_id"))
    revisits = stage(join_hot(heads, repeated, _SAME).where(others), "warc-revisits")
    if revisits.limit(1).count():
        gone = revisits.select("id_hash", *_SAME).distinct()
        rows = _without(rows, heads, gone)
    plan = ["page_id", "url", "payload_digest", "payload_bytes"]
    none = {"origin_id": F.lit(None).cast("long"), "origin_url": F.lit(None).cast("string")}
    out = rows.select(*plan, "payload", F.lit("response").alias("record_type")).withColumns(none)
    out = out.unionByName(revisits.select(*plan, "origin_id", "origin_url", F.lit(None).cast("string").alias("payload"), F.lit("revisit").alias("record_type")))
    map_arrow(out, _chunks(stamp), "chunk string").write.option("lineSep", LINE.decode()).option("maxRecordsPerFile", CHUNKS_PER_FILE).text(where)


def _digest(value: bytes | None) -> str | None:
    """The bare hexadecimal SHA-1 of a labelled digest, in base 32 or hexadecimal."""
    if not value or not value.lower().startswith(b"sha1:"):
        return None
    bare = value[5:].decode()
    return bare.lower() if len(bare) == 40 else base64.b32decode(bare.upper()).hex()


def _fields(lines: list[bytes]) -> dict[bytes, bytes]:
    pairs = (x.partition(b":") for x in lines if b":" in x)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(data: bytes | memoryview) -> Iterator[tuple[dict[bytes, bytes], dict[bytes, bytes], memoryview]]:
    """(WARC fields, HTTP fields, payload) of each record of an archive's bytes; lengths decide where records end."""
    whole, at = bytes(data), 0
    view = memoryview(whole)
    while at < len(whole):
        end = whole.find(LINE * 2, at)
        if end < 0 or not whole.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = _fields(whole[at:end].split(LINE)[1:])
        begin, size = end + 4, int(fields[b"content-length"])
        at = begin + size + 4
        if whole[at - 4 : at] != LINE * 2:
            raise ValueError(f"the record before byte {at} doesn't end where its length says")
        http: dict[bytes, bytes] = {}
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            head = whole.find(LINE * 2, begin, begin + size)
            head = begin + size - 4 if head < 0 else head
            http, begin = _fields(whole[begin:head].split(LINE)[1:]), head + 4
        yield fields, http, view[begin : at - 4]


def _read(payloads: bool) -> Callable:
    names = [x.split()[0] for x in HEADS.split(", ")] + ["payload"] * payloads
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                rows: list[tuple] = []
                size = 0
                for fields, http, payload in parse(content.as_buffer()):
                    kind, digest = fields.get(b"warc-type", b"").decode(), _digest(fields.get(b"warc-payload-digest"))
                    n = int(http[b"content-length"]) if b"content-length" in http else None
                    if kind == "response":
                        found = hashlib.sha1(payload).hexdigest()
                        if digest not in (None, found) or n not in (None, len(payload)):
                            raise ValueError(f"the payload of {fields[b'warc-record-id']!r} isn't the one that its record names")
                        digest, n = found, len(payload)
                    text = {k: fields[k].decode() if k in fields else None for k in (b"warc-record-id", b"warc-target-uri", b"warc-date", b"warc-refers-to")}
                    page = int(fields[PAGE_ID.lower()]) if PAGE_ID.lower() in fields else None
                    row = (kind, text[b"warc-record-id"], page, text[b"warc-target-uri"], text[b"warc-date"], digest, n, text[b"warc-refers-to"])
                    rows.append((*row, bytes(payload) if kind != "revisit" else None) if payloads else row)
                    size += len(payload) if payloads else 0
                    if len(rows) >= 10_000 or size >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def read_records(spark: SparkSession, where: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below ``where``: ``HEADS``, and ``payload`` (binary, null for revisits) if asked for.

    Digest and length of a response are those of the bytes read, and a record that names others raises ValueError; a
    revisit's are those of its headers. A file is read as a whole, so it must fit into a task's memory twice.
    """
    files = spark.read.format("binaryFile").load(where).select("content")
    return map_arrow(files, _read(payloads), HEADS + (", payload binary" if payloads else ""))


def _origins(records: DataFrame, wanted: str) -> DataFrame:
    """payload_digest, ref (a record's name, or empty for any), the wanted column of the largest such response."""
    responses = records.where("record_type = 'response' AND payload_digest IS NOT NULL")
    named = responses.select("payload_digest", F.explode(F.array(F.coalesce("record_id", F.lit("")), F.lit(""))).alias("ref"), F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("o"), wanted).alias("x"))
    return named.groupBy("payload_digest", "ref").agg(F.max("x").alias("x")).select("payload_digest", "ref", F.col(f"x.{wanted}").alias("origin"))


def resolve(records: DataFrame) -> DataFrame:
    """``HEADS`` and ``refers_to``: for a revisit the page id of its original response, else null.

    Revisits meet responses by payload digest and the name they refer to, or by the digest alone (the response with the
    largest page id) where they name none. A revisit without an original has null. ``records`` must be a staged table.
    """
    revisits = records.where("record_type = 'revisit'").withColumn("ref", F.coalesce("refers_to_id", F.lit("")))
    if revisits.limit(1).count() == 0:
        return records.withColumn("refers_to", F.lit(None).cast("long"))
    heads = [x.split()[0] for x in HEADS.split(", ")]
    found = join_hot(revisits, _origins(records, "page_id"), ["payload_digest", "ref"], "left").select(*heads, F.col("origin").alias("refers_to"))
    return records.where("record_type <> 'revisit'").select(*heads, F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def restore(records: DataFrame) -> DataFrame:
    """page_id, url, payload of each response and revisit of a table with payloads: a revisit gets its original's payload."""
    revisits = records.where("record_type = 'revisit'").withColumn("ref", F.coalesce("refers_to_id", F.lit("")))
    found = join_hot(revisits, _origins(records, "payload"), ["payload_digest", "ref"], "left")
    plain = lambda df, c: df.select("page_id", F.col("target_uri").alias("url"), F.col(c).cast("string").alias("payload"))
    return plain(records.where("record_type = 'response'"), "payload").unionByName(plain(found, "origin"))
