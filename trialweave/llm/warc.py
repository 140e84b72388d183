"""Web archives with one Zstandard frame for each record and the dictionary in a leading skippable frame.

``write_archives`` turns pages into ``.warc.zst`` files in the cluster's shared folder: each task trains
a dictionary on the first records of its file (bounded), stores it in a skippable frame, and then
compresses every record into a frame of its own, so a reader can start at any frame. File names hold a
fresh token for each attempt and the list of finished files is a table that Spark commits: files of lost
or repeated attempts are never read. ``read_archives`` streams the listed files, decodes frame after
frame and checks version, headers, lengths and digests; a damaged archive raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import scratch_path, written

# Fixed values of the formats: skippable-frame numbers, frame start, line ends.
DICTIONARY_FRAME, SKIPPABLE = 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
FRAME_START = b"\x28\xb5\x2f\xfd"
CRLF = b"\r\n"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value without the characters that would end its line."""
    return "".join(f"%{b:02X}" if b <= 32 else chr(b) for b in value.encode()) if not value.isprintable() or " " in value else value


def encode_record(page_id: int | None, url: str | None, payload: bytes, response: int | None, date: str) -> bytes:
    """One record; ``response`` is the page whose payload a revisit repeats, None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if response is not None else http + payload
    head = [
        ("WARC-Type", "response" if response is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("WARC-Block-Digest", "sha1:" + digest32(block)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if response is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{response}>")]
    head.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}".encode() + CRLF for k, v in head)
    return VERSION + CRLF + lines + CRLF + block + CRLF + CRLF


def _page_of(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "None" else int(name)


def decode_record(record: bytes) -> dict:
    """The validated content of one record."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"archive record: {what}")

    head, mark, body = record.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    need(bool(mark) and lines[0] == VERSION, "no version line or no end of headers")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        need(bool(colon) and bool(name) and name.lower() not in fields, f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        need(name in fields, f"header {name} is missing")
    need(fields["content-length"].isdigit(), "length is no number")
    length = int(fields["content-length"])
    need(len(body) == length + 4 and body.endswith(CRLF + CRLF), f"length {length} does not fit {len(body)} bytes")
    block = body[:length]
    need(fields.get("warc-block-digest", "sha1:" + digest32(block)) == "sha1:" + digest32(block), "block digest differs")
    http, mark, payload = block.partition(CRLF + CRLF)
    need(bool(mark), "no end of HTTP headers")
    sizes = [x.split(b":")[1] for x in http.split(CRLF) if x.lower().startswith(b"content-length:")]
    need(len(sizes) == 1 and sizes[0].strip().isdigit(), "HTTP length is missing")
    size, kind = int(sizes[0]), fields["warc-type"]
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    need(kind in ("response", "revisit"), f"unknown type {kind}")
    if kind == "response":
        need(len(payload) == size, "payload length differs")
        need(stated == digest32(payload), "payload digest differs")
    else:
        need(not payload and bool(stated) and "warc-refers-to" in fields, "incomplete revisit")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": kind,
        "refers_to": _page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def dictionary_frame(samples: list[bytes], size: int) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """A skippable frame with a trained dictionary; nothing where there are too few samples to train."""
    try:
        trained = zstandard.train_dictionary(size, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        trained = None
    if trained is None:
        return b"", None
    packed = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed, trained


def read_frames(source: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each frame of a stream; the dictionary comes from the leading skippable frame."""
    data, ended, decoder = b"", False, zstandard.ZstdDecompressor()
    first = True

    def more() -> bool:
        nonlocal data, ended
        got = b"" if ended else source.read(chunk)
        ended = ended or not got
        data += got
        return bool(got)

    while True:
        while len(data) < 8 and more():
            pass
        if not data:
            return
        if len(data) >= 8 and struct.unpack_from("<I", data)[0] in SKIPPABLE:
            number, size = struct.unpack_from("<II", data)
            while len(data) < 8 + size and more():
                pass
            if len(data) < 8 + size:
                raise ValueError("archive ends inside a skippable frame")
            if number == DICTIONARY_FRAME and first:
                content = data[8 : 8 + size]
                if content.startswith(FRAME_START):
                    content = zstandard.ZstdDecompressor().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            data, first = data[8 + size :], False
            continue
        if not data.startswith(FRAME_START):
            raise ValueError("no frame where one should start")
        one, out = decoder.decompressobj(), []
        while not one.eof:
            if not data and not more():
                raise ValueError("archive ends inside a frame")
            out.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        first = False
        yield b"".join(out)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``response``: for repeated payloads of at least ``min_bytes``
    bytes the largest ``page_id`` that has the payload, otherwise null.

    Only digests are grouped (with partial aggregation); the pages meet the repeated digests in a join
    whose large keys Spark can split.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_sum", F.sha1("html"))
    repeated = (
        rows.filter(F.octet_length("html") >= min_bytes)
        .groupBy("_sum").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
        .filter("_n > 1").drop("_n")
    )
    return rows.join(repeated, "_sum", "left").select(
        "page_id", "url", "html",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_last")), F.col("_last")).alias("response"),
    )


def write_archives(
    pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 64 << 20, dictionary_bytes: int = 64 << 10,
    dictionary_records: int = 500, date: str = "1970-01-01T00:00:00Z", level: int = 3,
) -> DataFrame:
    """Write a record for each page and return the list of archives: ``path``, ``bytes``, ``records``.

    Input: ``page_id``, ``url``, ``html``. A null html is an empty payload, a null url leaves the header
    out, a null page_id is kept as such. Of equal payloads the page with the largest page_id is the
    response and the others are revisits; repeated rows of that page are responses too, and where every
    such page_id is null all are responses. An empty table gives no archive. At most
    ``dictionary_records`` records (of at most 4 MB together) of an archive train its dictionary.
    """
    root = scratch_path(pages.sparkSession, "archives")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        made = 0

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html, response in zip(batch.page_id, batch.url, batch.html, batch.response, strict=True):
                    yield encode_record(
                        None if pd.isna(page) else int(page), url, html.encode(), None if pd.isna(response) else int(response), date
                    )

        feed = records()
        waiting = next(feed, None)
        while waiting is not None:
            samples, held = [], 0
            while waiting is not None and len(samples) < dictionary_records and held < 4 << 20:
                samples.append(waiting)
                held += len(waiting)
                waiting = next(feed, None)
            frame, trained = dictionary_frame([x[:16384] for x in samples], dictionary_bytes)
            packer = zstandard.ZstdCompressor(level=level, dict_data=trained)
            path = f"{root}/{token}-{made:04d}.warc.zst"
            made += 1
            system, place = _open(path)
            system.create_dir(place.rpartition("/")[0], recursive=True)
            size = count = 0
            with system.open_output_stream(place) as out:
                size += out.write(frame) or len(frame)
                for record in samples:
                    packed = packer.compress(record)
                    out.write(packed)
                    size, count = size + len(packed), count + 1
                while waiting is not None and size < archive_bytes:
                    packed = packer.compress(waiting)
                    out.write(packed)
                    size, count = size + len(packed), count + 1
                    waiting = next(feed, None)
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [count]})

    rows = revisits(pages, min_bytes).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
        F.col("response").cast("long").alias("response"),
    )
    return written(rows.mapInPandas(write, "path string, bytes long, records long"), "archive-list")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the listed archives: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to`` and, if asked for, ``payload`` (null for revisits)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                system, place = _open(path)
                rows, held = [], 0
                with system.open_input_stream(place) as source:
                    for record in read_frames(source):
                        row = decode_record(record)
                        if not with_payload:
                            del row["payload"]
                        rows.append(row)
                        held += len(record) if with_payload else 400
                        if held > 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    def _frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    payload = ", payload binary" if with_payload else ""
    many = max(1, archives.count())
    return archives.select("path").repartition(many, "path").mapInPandas(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + payload
    )
