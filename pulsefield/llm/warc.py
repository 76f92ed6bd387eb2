"""WARC sink and splittable WARC reader.

Sink: rows become gzip members, one per record, in one archive per task. Rows with equal payloads
(by SHA-256) of at least ``revisit_bytes`` bytes are stored once, as the response record of the
smallest id; the others become revisit records that name it.

Reader: an archive is dealt out as byte ranges. A task scans its range for the gzip magic, validates
a candidate by decoding its start (a member must open with a WARC version line, so magic bytes
inside compressed data don't count), and owns every record of the members that start inside its range, reading
past the range's end where the last one needs it. Memory is bounded by the largest member.

Other writers' archives: a member may hold several records, field names have any case, ids any form (page_id and refers_to
are null unless this sink made them; record_id and refers_to_id give them as they stand), records of other types and blocks that aren't HTTP
have their whole block as payload, and a revisit without a payload length has null payload_bytes. Nothing is lost in silence: a
member or record that ends early, bytes after a member that start no other, and a record without a length raise, naming the
archive and offset; with strict=False such pieces are passed over. An archive inside a record that deflate stored unpacked can't be told from members of
the outer one by a task that starts behind its head.

Edge cases: a null html is an empty payload, a null url an empty target, a null id is kept as null. Payloads below
the limit are always responses. Rows that repeat the smallest id of a group are all
responses. An empty table makes no archive and reads back as no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.llm.common import materialize, shared_folder, table
from pulsefield.llm.files import reading, replacing

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
#: Pages carry no fetch time; a fixed date keeps archives of equal input equal.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, revisit_bytes: int = 100, salts: int = 32) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to, the id of the response or null.

    A payload may belong to any share of the pages, so the join back to the groups is salted.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    large = rows.where(F.col("payload_bytes") >= revisit_bytes)
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    joined = salted.join(groups, ["payload_digest", "salt"], "left")
    revisits = (F.col("payload_bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(revisits, F.col("first_id"))).drop("first_id", "salt")


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]+", " ", url).strip()


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record, not yet compressed."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return CRLF.join(x.encode() for x in head) + CRLF * 2 + block + CRLF * 2


def write_warc(rows: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write with_revisits() rows as archives in folder; a row (path, length, records) per archive."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (b for b in batches if len(b))
        if (batch := next(batches, None)) is None:
            return
        uri, n, length = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0
        with replacing(uri) as out:
            while batch is not None:
                for row in batch.itertuples(index=False):
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(record(page_id, row.url or "", row.payload, row.payload_digest, row.payload_bytes, refers_to)) + z.flush()
                    out.write(member)
                    n, length = n + 1, length + len(member)
                batch = next(batches, None)
        yield pd.DataFrame({"path": [uri], "length": [length], "records": [n]})

    # Ids stay whole numbers beside nulls as strings, which pandas doesn't turn into floats.
    ready = rows.select(F.col("page_id").cast("string"), "url", "payload", "payload_digest", "payload_bytes", F.col("refers_to").cast("string"))
    return ready.mapInPandas(write, "path string, length long, records long")


class Broken(ValueError):
    """An archive that ends early or holds what is no record."""


def _inflate(source, at: int, size: int, step: int) -> tuple[bytes, int, bool] | None:
    """The member at a file's offset, the offset after it and whether it is whole; None if no WARC record starts there."""
    z, out, first, pos = zlib.decompressobj(31), [], True, at
    source.seek(at)
    try:
        while not z.eof:
            data = source.read(min(step, size - pos))
            if not data:
                break
            pos += len(data)
            piece = z.decompress(data)
            if first and piece:
                if not piece.startswith(b"WARC/1."[: len(piece)]):
                    return None
                first = len(piece) < 7
            out.append(piece)
    except zlib.error:
        whole = b"".join(out)
        return (whole, at + len(MAGIC), False) if whole.startswith(b"WARC/1.") else None
    whole = b"".join(out)
    return (whole, pos - len(z.unused_data), z.eof) if whole.startswith(b"WARC/1.") else None


def members(source, start: int, end: int, size: int, step: int = 1 << 16, strict: bool = True) -> Iterator[bytes]:
    """The members that start in [start, end) of an open archive of that size and open with a WARC record."""
    at, chained = start, start == 0  # chained: a member must start at this offset
    while at < end:
        source.seek(at)
        window = source.read(min(step, size - at))
        hit = window.find(MAGIC)
        if strict and chained and hit != 0 and size:
            raise Broken(f"no member at offset {at}")
        if hit < 0 or at + hit >= end:
            if at + len(window) >= min(end + len(MAGIC), size) or len(window) < len(MAGIC):
                return
            at += len(window) - len(MAGIC) + 1
            continue
        found = _inflate(source, at + hit, size, step)
        if found is None:
            if strict and chained:
                raise Broken(f"no WARC record in the member at offset {at}")
            at += hit + 1
        elif not found[2]:
            if strict:
                raise Broken(f"the member at offset {at + hit} is damaged or ends early")
            at, chained = at + hit + 1, False
        else:
            yield found[0]
            at, chained = found[1], True
            if strict and end <= at < size:  # the next range can't tell
                source.seek(at)
                if source.read(len(MAGIC)) != MAGIC:
                    raise Broken(f"no member at offset {at}")


def _page_id(urn: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", urn or "")
    return found[1] if found else None


def records(member: bytes, strict: bool = True) -> Iterator[dict]:
    """The records of a member: type, ids, target and payload, None for a revisit."""
    at = 0
    while member[at : at + 5] == b"WARC/":
        stop = member.find(CRLF * 2, at)
        lines = member[at : stop if stop >= 0 else len(member)].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {name.strip().lower(): value.strip() for name, sign, value in (x.partition(":") for x in lines) if sign}
        length = fields.get("content-length", "")
        if stop < 0 or not length.isdigit() or stop + 4 + int(length) > len(member):
            if strict:
                raise Broken("a record ends early or has no length")
            return
        block = member[stop + 4 : stop + 4 + int(length)]
        at = stop + 4 + int(length)
        while member[at : at + 2] == CRLF:
            at += 2
        yield _fields(fields, block)
    if strict and member[at:].strip():
        raise Broken("bytes after a record start no other")


def _fields(fields: dict[str, str], block: bytes) -> dict:
    kind = fields.get("warc-type", "").lower()
    http = fields.get("content-type", "").lower().replace(" ", "").startswith("application/http") and CRLF * 2 in block
    payload = None if kind == "revisit" else block.partition(CRLF * 2)[2] if http else block
    stated, digest = fields.get("x-payload-length", ""), fields.get("warc-payload-digest", "")
    return {
        "page_id": _page_id(fields.get("warc-record-id")),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri", ""),
        "payload": payload,
        "payload_bytes": len(payload) if payload is not None else int(stated) if stated.isdigit() else None,
        "payload_digest": hashlib.sha256(payload).hexdigest() if payload is not None else digest.removeprefix("sha256:") or None,
        "refers_to": _page_id(fields.get("warc-refers-to")),
        "record_id": fields.get("warc-record-id"),
        "refers_to_id": fields.get("warc-refers-to"),
    }


READ_SCHEMA = "page_id string, record_type string, target_uri string, payload binary, payload_bytes string, payload_digest string, refers_to string, record_id string, refers_to_id string"


def read_warc(archives: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of archives, rows (path, length), read in byte ranges of split_bytes."""
    ranges = archives.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, start in batch.itertuples(index=False):
                rows, held = [], 0
                with reading(path) as source:
                    try:
                        for data in members(source, start, min(start + split_bytes, length), length, strict=strict):
                            for row in records(data, strict):
                                if not with_payload:
                                    row["payload"] = None
                                row["payload_bytes"] = None if row["payload_bytes"] is None else str(row["payload_bytes"])
                                rows.append(row)
                                held += len(row["payload"] or b"") + 200
                                if held > 4 << 20:
                                    yield pd.DataFrame(rows)
                                    rows, held = [], 0
                    except Broken as e:
                        raise Broken(f"{path}: {e}") from e
                if rows:
                    yield pd.DataFrame(rows)

    tasks = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    out = ranges.repartition(tasks * 2, "path", "start").mapInPandas(read, READ_SCHEMA)
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to", "payload_bytes")})


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the archives in a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    archives = materialize(write_warc(rows, shared_folder(spark, "warc")), "archives")  # one small row per archive
    back = read_warc(archives, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to, target_uri
FROM f
"""
