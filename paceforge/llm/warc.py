"""Dictionary-compressed web archives (.warc.zst).

An archive starts with a skippable frame that holds a Zstandard dictionary, followed by one frame per
record compressed with it, so every record can be read alone. Archives are rows (name, content) of a
table, each at most ``archive_bytes`` of records plus one record: that works on any store Spark writes
to. ``export_archives`` writes them out as files where the store has a file system.

Every record has the mandatory fields (type, id, date, length). Ids come from the page and the row's number in
a staged table, so they differ for repeated rows and a revisit can name its response.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceforge.llm.common import Tables, by_batch, utf8
from paceforge.session import stage

#: Fixed value: skippable frame of a dictionary at the start of an archive.
DICTIONARY_MAGIC = 0x184D2A5D
_RESULT = "payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:row:{row}')}>"


def format_record(
    page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, date: str, refers_to: int | None, refers_row: int | None
) -> bytes:
    """One WARC/1.1 record. A revisit has no body and names the record it repeats."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, row)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "" if url is None else " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, refers_row)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    return fields, rest[:length]


def build_dictionary(records: list[bytes], size: int = 16_384, sample_bytes: int = 1_000_000) -> bytes:
    """A dictionary from records of the archive: every n-th one, so that about ``sample_bytes`` are read.

    Too few or too small samples give their own bytes as a raw dictionary, which decoders accept as well.
    """
    every = max(1, sum(map(len, records)) // sample_bytes)
    sample = [r[: sample_bytes // 8] for r in records[::every]]
    try:
        return zstandard.train_dictionary(size, sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-size:]


def pack_archive(records: list[bytes], level: int = 6) -> bytes:
    raw = build_dictionary(records)
    writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw))
    frames = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw]
    frames += [writer.compress(r) for r in records]
    return b"".join(frames)


def read_archive(content: bytes, step: int = 16_384) -> Iterator[bytes]:
    """The records of an archive, one frame each, in time proportional to its size.

    Frames are fed ``step`` bytes at a time, so what a decoder hands back at a frame's end stays small.
    """
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    words = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=words)
    view, at = memoryview(content), 8 + size
    while at < len(view):
        one, record = reader.decompressobj(), []
        while not one.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("archive ends inside a record")
            record.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(record)


def _write(archive_bytes: int, date: str):
    def run(batches: Tables) -> Tables:
        records: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            content = pack_archive(records)
            name = f"{hashlib.sha256(content).hexdigest()[:32]}.warc.zst"
            return pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(records)], pa.int64()), "content": pa.array([content], pa.binary())})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "row", "url", "body", "refers_to", "refers_row"))
            for page, row, url, body, refers, refers_row in zip(*columns, strict=True):
                payload = body or b""
                records.append(format_record(page, row, url, payload, payload_digest(payload), date, refers, refers_row))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield close()
                    records, held = [], 0
        if records:
            yield close()

    return run


def write_archives(
    pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 16_000_000, date: str | None = None
) -> DataFrame:
    """Archives of ``pages`` as a staged table: name, records, content.

    One record per row with the html as payload. Of rows whose payloads are equal and have at least
    ``least_bytes`` bytes, those with the largest page_id are responses and the others revisits of the first
    of these. ``date`` (UTC, like 2024-05-01T00:00:00Z) is the date of all records; the time of the call if
    none is given.

    Null html: an empty payload. Null page_id: never the largest; equal payloads without any page_id are
    all responses, as nothing can be referred to. Repeated rows with the largest page_id are all
    responses. Null url: an empty target. Other columns are ignored; an empty table gives no archives.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(utf8("html"), F.lit(b"")).alias("body")
    ).withColumn("same", F.concat_ws("-", F.sha1("body"), F.octet_length("body")))
    # written once, so that a row keeps its number whatever is computed again
    own = stage(own.withColumn("row", F.monotonically_increasing_id()), "warc-pages", compression="zstd")
    first = stage(
        own.filter(F.octet_length("body") >= least_bytes)
        .groupBy("same")
        .agg(F.max(F.struct("page_id", (-F.col("row")).alias("back"))).alias("largest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("same", F.col("largest.page_id").alias("largest"), (-F.col("largest.back")).alias("largest_row")),
        "warc-first",
    )
    revisit = ~F.col("page_id").eqNullSafe(F.col("largest"))
    marked = own.join(first, "same", "left").select(
        "page_id",
        "row",
        "url",
        "body",
        F.when(revisit, F.col("largest")).alias("refers_to"),
        F.when(revisit & F.col("largest").isNotNull(), F.col("largest_row")).alias("refers_row"),
    )
    return stage(marked.mapInArrow(_write(archive_bytes, date), "name string, records long, content binary"), "warc-archives")


def _read(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
    for content in batch.column("content"):
        for record in read_archive(content.as_py()):
            fields, body = parse_record(record)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and (len(body) != int(fields["X-Payload-Length"]) or payload_digest(body) != digest):
                raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its digest")
            out["page_id"].append(int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None)
            out["payload_bytes"].append(int(fields["X-Payload-Length"]))
            out["payload_digest"].append(digest)
            out["record_type"].append(fields["WARC-Type"])
            refers = fields.get("X-Refers-To-Page-ID")
            out["refers_to"].append(int(refers) if refers else None)
    longs = {c: pa.array(out[c], pa.int64()) for c in ("page_id", "payload_bytes", "refers_to")}
    return out | longs | {c: pa.array(out[c], pa.string()) for c in ("payload_digest", "record_type")}


def read_records(archives: DataFrame) -> DataFrame:
    """One row per record, decompressed and parsed; bodies are checked against their digests."""
    return by_batch(archives.select("content"), _read, f"page_id long, {_RESULT}")


def export_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file. ``folder`` must be a path that all executors mount.

    A file gets its final name only when it is whole, so a task that is run again overwrites nothing
    but equal content.
    """

    def save(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = os.path.join(folder, f".{row['name']}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row["content"])
            os.replace(part, os.path.join(folder, row["name"]))

    archives.select("name", "content").foreachPartition(save)
