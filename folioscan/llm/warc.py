"""WARC records in ZIP packages: written per page, read back by ranges through the package's own directories."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, save, shared_dir

#: ZIP's signatures and the sizes of its fixed parts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: An archive is closed when its records reach so many bytes.
ARCHIVE_BYTES = 16 << 20


def filesystem(uri: str):
    """(file system, path) of a folder that all executors share; file, hdfs, s3 and gs addresses work."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _extra64(values: list[int]) -> bytes:
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False, at: int = 0) -> bytes:
    """A ZIP file of stored members.  ZIP64 fields stand wherever a value needs them, or everywhere if ``zip64``."""
    out, central = [], []
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        big = zip64 or n >= MAX32
        extra = _extra64([n, n] if big else [])
        head = struct.pack("<4s5H3I2H", LOCAL, 45 if big else 20, 0x0800, 0, 0, 33, crc, MAX32 if big else n, MAX32 if big else n, len(raw), len(extra)) + raw + extra
        far = zip64 or at >= MAX32
        extra = _extra64(([n, n] if big else []) + ([at] if far else []))
        central.append(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45 if big or far else 20, 0x0800, 0, 0, 33, crc, MAX32 if big else n, MAX32 if big else n, len(raw), len(extra), 0, 0, 0, 0, MAX32 if far else at) + raw + extra)
        out += [head, data]
        at += len(head) + n
    listing = b"".join(central)
    k, size = len(central), len(listing)
    tail = b""
    if zip64 or k >= MAX16 or at >= MAX32:
        tail = struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, k, k, size, at) + struct.pack("<4sIQI", LOCATOR64, 0, at + size, 1)
        k, size, at = MAX16, MAX32, MAX32
    return b"".join([*out, listing, tail, struct.pack("<4s4H2IH", END, 0, 0, k, k, size, at, 0)])


def zip_directory(f, size: int) -> dict[str, dict]:
    """The members of a ZIP file by name (method, size, stored, crc, offset), from its central directory alone.

    ``f`` is a seekable file.  The end record is found from the end, past a comment of any length; a ZIP64 locator
    before it leads to the 64-bit record.
    """
    reach = min(size, 22 + MAX16 + 20)
    f.seek(size - reach)
    tail = f.read(reach)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > reach or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != reach):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    _, _, _, _, count, length, offset, _ = struct.unpack_from("<4s4H2IH", tail, at)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack_from("<4sIQI", tail, at - 20)[2]
        f.seek(where)
        record = f.read(56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator leads to no ZIP64 record")
        count, length, offset = struct.unpack_from("<3Q", record, 32)
    f.seek(offset)
    listing, out, p = f.read(length), {}, 0
    for _ in range(count):
        sig, _, _, _, method, _, _, crc, packed, whole, n, m, c, _, _, _, start = struct.unpack_from("<4s6H3I5H2I", listing, p)
        if sig != CENTRAL:
            raise ValueError("broken central directory")
        name, extra = listing[p + 46 : p + 46 + n].decode(), listing[p + 46 + n : p + 46 + n + m]
        q = 0
        while q + 4 <= len(extra):
            kind, length64 = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                more = iter(struct.unpack_from(f"<{length64 // 8}Q", extra, q + 4))
                whole, packed, start = (next(more) if whole == MAX32 else whole), (next(more) if packed == MAX32 else packed), (next(more) if start == MAX32 else start)
            q += 4 + length64
        out[name] = {"method": method, "size": whole, "stored": packed, "crc": crc, "offset": start}
        p += 46 + n + m + c
    return out


def member_start(f, entry: dict) -> int:
    """Where a stored member's bytes begin."""
    if entry["method"] != 0:
        raise ValueError("only stored members can be read by ranges")
    f.seek(entry["offset"])
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError("broken local header")
    n, m = struct.unpack_from("<2H", head, 26)
    return entry["offset"] + 30 + n + m


def index_lines(f, members: dict[str, dict]):
    """Lines of every index of an archive, in gzip parts or plain; indexes of such parts (``.idx``) and heads say nothing of records."""
    for name in sorted(m for m in members if m.startswith("indexes/") and m.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))):
        f.seek(member_start(f, members[name]))
        data = f.read(members[name]["size"])
        lines = (gzip.decompress(data) if name.endswith(".gz") else data).decode().splitlines()
        yield from (x for x in lines if "{" in x and not x.startswith("!"))


def _name(key) -> str:
    return f"<urn:page:{'none' if key is None else key}>"


def _key(name: str):
    x = name.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "none" else int(x)


def warc_record(page_id, url, payload: bytes, first=None) -> tuple[bytes, str]:
    """One WARC record, and its payload's digest: a response, or a revisit of page ``first`` that leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(first)}"]
        payload = b""
    block = http + payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n", digest


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (keys in lower case) and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda h: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in h.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, fields(http), body


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a WARC record; returns (archive, bytes, records), saved.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the smallest page_id is a response and the others
    revisit it.  A null html is an empty payload, a null url is left out; rows without a page_id revisit a row that
    has one, else they are responses; rows that repeat a response's page_id are responses too.  Archives have names of
    their own for every attempt of a task, and only those in the saved list count, so a task that runs twice leaves no
    trace in what is read.
    """
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "coalesce(html, '') payload").withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    copies = rows.select("digest", "page_id", F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copies = save(copies, "warc-copies")
    todo = rows.join(copies, "digest", "left").select("page_id", "url", "payload", F.when(~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), F.col("first")).alias("first"))

    def run(batches):
        claim("warc")
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        records, index, size = [], [], 0

        def close():
            data = b"".join(records)
            name = f"{uuid.uuid4().hex}.wacz"
            lines = "".join(sorted(index)).encode()
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(zip_stored([(DATA, data), (INDEX, lines)]))
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [len(data)], "records": [len(index)]})

        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record, digest = warc_record(page_id, url, payload.encode(), first)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(record) + packer.flush()
                index.append(f"{_name(page_id)} 19700101000000 {json.dumps({'offset': size, 'length': len(packed), 'digest': digest, 'filename': 'data.warc.gz'})}\n")
                records.append(packed)
                size += len(packed)
                if size >= archive_bytes:
                    yield close()
                    records, index, size = [], [], 0
        if records:
            yield close()

    return save(todo.mapInArrow(run, "archive string, bytes long, records long"), "warc-list")


def read_archives(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Read archives (archive: name in ``folder``) back: one row per record, found by the index and read by its range.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for
    revisits).  A response whose bytes don't give its digest is an error.  Nothing is extracted or read as a whole
    except the indexes, which may be compressed, and the central directory.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload string" if payload else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()][: len(names)]

    def records(fs, path):
        info = fs.get_file_info(path)
        with fs.open_input_file(path) as f:
            members = zip_directory(f, info.size)
            starts = {}
            for line in index_lines(f, members):
                at = json.loads(line[line.index("{") :])
                member = f"archive/{at['filename']}"
                if member not in starts:
                    starts[member] = member_start(f, members[member])
                f.seek(starts[member] + int(at["offset"]))
                warc, http, body = parse_record(zlib.decompress(f.read(int(at["length"])), 31))
                digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                if kind == "response" and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != int(http["content-length"])):
                    raise ValueError(f"{path}: a record's payload does not give its digest")
                refers = _key(warc["warc-refers-to"]) if kind == "revisit" else None
                yield _key(warc["warc-record-id"]), warc.get("warc-target-uri"), int(http["content-length"]), digest, kind, refers, body.decode() if kind == "response" and payload else None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: len(names)], types, strict=True)], names=names)

    def run(batches):
        claim("warc")
        fs, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in records(fs, f"{root}/{name}"):
                    rows.append(row)
                    held += row[2] if payload else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    spread = max(1, min(archives.count(), 100_000))
    return archives.select("archive").repartition(spread).mapInArrow(run, schema)


def archive_folder(spark) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
