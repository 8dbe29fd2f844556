"""WARC records in ZIP packages: writing with revisit records, and reading by ranges without extraction.

A package is a ZIP archive of stored members: ``archive/data.warc.gz``, in which each record is a gzip member of its own, and
``indexes/index.cdxj``, which names each record's file, offset and length. The reader asks a source for byte ranges only: the
end records (ZIP64 ones where the plain ones overflow), the central directory, a member's local header, the index, and then
single records. It takes any stored archive and index members; archives that no index names are read member by member.

Packages are files in the shared folder and are read by seeking in them; where that folder is in a store that workers can't
open, they are values of a table instead.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import lean, shared_folder, trimmed, whole_text, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of payload in a package, after which it is closed.
PACKAGE = 4 << 20
#: Bytes read at a time of an archive without an index.
WINDOW = 1 << 18
FULL = 0xFFFFFFFF

Fetch = Callable[[int, int], bytes]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record with the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c for c in url or "" if c > " ") or f"urn:x-page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def package(records: list[bytes]) -> bytes:
    """A ZIP package of the records, in order."""
    data, index, at = [], [], 0
    for raw in records:
        press = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = press.compress(raw) + press.flush()
        index.append("urn:x-record 19700101000000 " + json.dumps({"filename": DATA.rpartition("/")[2], "offset": at, "length": len(member)}))
        data.append(member)
        at += len(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((DATA, b"".join(data)), (INDEX, "".join(f"{x}\n" for x in index).encode())):
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def members(fetch: Fetch, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of each stored member."""
    tail_at = max(0, size - 22 - 0xFFFF - 20)
    tail = fetch(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no ZIP archive")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07" and (count == 0xFFFF or FULL in (length, start)):
        where = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
        end = fetch(where, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    directory, out, at = fetch(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        packed, plain, name_size, extra_size, note_size = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        offset = struct.unpack("<I", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_size : at + 46 + name_size + extra_size]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == FULL else plain
                packed = next(wide) if packed == FULL else packed
                offset = next(wide) if offset == FULL else offset
            extra = extra[4 + n :]
        at += 46 + name_size + extra_size + note_size
        if method == 0 and packed == plain and not flags & 1:
            local = fetch(offset, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("local header")
            name_here, extra_here = struct.unpack("<HH", local[26:30])
            out[name] = (offset + 30 + name_here + extra_here, plain)
    return out


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields of a header with a first line, by lower-case name, and what follows it."""
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}, rest


def parse(raw: bytes) -> dict:
    """page_id (of records written here), record_id, payload_bytes, payload_digest, record_type, refers_to and payload of a
    record; revisits have no payload, and without an HTTP header no size. A digest that does not fit raises."""
    fields, rest = headers(raw)
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError(f"length of {fields.get('warc-record-id')}")
    page = lambda uri: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")) else None
    known = fields.get("warc-payload-digest", "")
    out = {"page_id": page(fields["warc-record-id"]), "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to")), "payload_digest": known.removeprefix("sha1:") or None, "payload": None}
    http, payload = headers(block) if fields.get("content-type", "").startswith("application/http") else ({}, block)
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(http["content-length"]) if "content-length" in http else None}
    out |= {"payload": payload, "payload_bytes": len(payload)}
    if out["payload_digest"] is None:
        out["payload_digest"] = digest(payload)
    elif known.startswith("sha1:") and digest(payload) != out["payload_digest"]:
        raise ValueError(f"payload of {fields['warc-record-id']}")
    return out


def indexed(text: bytes) -> Iterator[dict]:
    """Entries of an index: JSON lines, with or without a key and a time before them."""
    for line in text.splitlines():
        at = line.find(b"{")
        if at >= 0 and not line.startswith(b"!"):
            yield json.loads(line[at:])


def gzip_members(fetch: Fetch, start: int, size: int) -> Iterator[bytes]:
    """The parts of a file of gzip members, read a window at a time."""
    at, end = start, start + size
    while at < end:
        press, out, more = zlib.decompressobj(31), [], at
        while not press.eof:
            if more >= end:
                raise ValueError("end of archive")
            window = fetch(more, min(WINDOW, end - more))
            more += len(window)
            out.append(press.decompress(window))
        at = more - len(press.unused_data)
        yield b"".join(out)


def records(fetch: Fetch, size: int) -> Iterator[dict]:
    """The records of a package, each by a range of its own; of archives that no index names, one after another."""
    found = members(fetch, size)
    archives = {name.rpartition("/")[2]: place for name, place in found.items() if re.search(r"\.warc(\.gz)?$", name)}
    named = set()
    if not archives:
        raise ValueError("a package without archives")
    for name in sorted(found):
        if re.search(r"(^|/)index(es)?/?[^/]*\.cdxj?(\.gz)?$", name):
            text = fetch(*found[name])
            for entry in indexed(b"".join(gzip_members(lambda at, n, text=text: text[at : at + n], 0, len(text))) if name.endswith(".gz") else text):
                archive = entry.get("filename", next(iter(archives))).rpartition("/")[2]
                named.add(archive)
                raw = fetch(archives[archive][0] + int(entry["offset"]), int(entry["length"]))
                yield parse(zlib.decompress(raw, 31) if archive.endswith(".gz") else raw)
    for name in sorted(archives.keys() - named):
        if name.endswith(".gz"):
            yield from map(parse, gzip_members(fetch, *archives[name]))
        else:
            yield from plain_records(fetch, *archives[name])


def plain_records(fetch: Fetch, start: int, size: int) -> Iterator[dict]:
    """The records of an uncompressed archive: a header, its block by a range, and two empty lines."""
    at, end = start, start + size
    while at < end:
        head, more = b"", at
        while b"\r\n\r\n" not in head:
            if more >= end:
                raise ValueError("end of archive")
            head += fetch(more, min(WINDOW, end - more))
            more = at + len(head)
        length = head.index(b"\r\n\r\n") + 4 + int(headers(head)[0]["content-length"])
        yield parse(fetch(at, length))
        at += length + 4


def qualified(spark, path: str) -> str:
    """The path with the scheme and host that Spark's file systems take it to have: a worker reads a bare one as its own disk's."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it. Raises for stores that this process can't open."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _packaged(batches: Iterator[pa.RecordBatch], limit: int, folder: str | None) -> Iterator[pa.RecordBatch]:
    def row(held: list[bytes]) -> pa.RecordBatch:
        content, path = package(held), None
        if folder:
            # a name of its own for each attempt: the table of packages holds those of tasks that ended well
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            store, place = opened(path)
            store.create_dir(place.rpartition("/")[0])
            with store.open_output_stream(place) as out:
                out.write(content)
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([None if folder else content], pa.binary()), pa.array([len(content)])], ["path", "content", "size"])

    held, size = [], 0
    for batch in batches:
        for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
            payload = payload.as_py()
            held.append(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py()))
            size += len(held[-1])
            if size >= limit:
                yield row(held)
                held, size = [], 0
    if held:
        yield row(held)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "record_id": pa.string()}

    def shipped(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r in found:
            rows.append(r)
            size += len(r["payload"] or b"")
            if size >= PACKAGE or len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in kinds.items()], list(kinds))
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in kinds.items()], list(kinds))

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            if path is not None:
                store, place = opened(path)
                with store.open_input_file(place) as file:
                    yield from shipped(records(lambda at, n: file.read_at(n, at), file.size()))
            elif content.is_valid:
                view = content.as_buffer()
                yield from shipped(records(lambda at, n, view=view: view.slice(at, n).to_pybytes(), view.size))


def write_packages(pages: DataFrame, least_bytes: int = 0, limit: int = PACKAGE) -> DataFrame:
    """Packages (path or content, size) of a record for each row of ``pages`` (columns used: page_id, url, html; others are
    ignored). They are written when the result is: write it once and read packages from that.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is a response, others
    revisit it; rows that share this smallest id are all responses. A null html is an empty payload; a row with a null
    page_id is a response; a null url is named after the page. No rows, no packages.
    """
    folder = qualified(pages.sparkSession, f"{shared_folder(pages.sparkSession)}/{pages.sparkSession.sparkContext.applicationId}-{uuid.uuid4().hex}")
    try:
        opened(folder)
    except (ValueError, OSError, NotImplementedError):
        folder = None
    payload = whole_text("html")
    rows = lean(pages).select("page_id", "url", payload.alias("payload"))
    keys = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha1("payload").alias("key"), F.octet_length("payload").alias("size"))
    shared = written(keys.groupBy("key", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last"))
    again = keys.join(shared, ["key", "size"]).where("page_id > refers_to").select("page_id", F.col("key"), "refers_to").distinct()
    # a page's rows may differ in payload: the key belongs to the join, under names of its own
    again = again.select(F.col("page_id").alias("p"), F.col("key").alias("k"), "refers_to")
    joined = rows.join(again, (F.col("page_id") == F.col("p")) & (F.sha1("payload") == F.col("k")), "left")
    return joined.select("page_id", "url", "payload", "refers_to").mapInArrow(lambda it: trimmed(_packaged(it, limit, folder)), "path string, content binary, size long")


def read_packages(packages: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) and
    record_id. ``packages`` has path or content, or both; a row with neither has no records. Damaged packages raise."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string"
    given = [F.col(c) if c in packages.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("path", "string"), ("content", "binary"))]
    return lean(packages).select(*given).mapInArrow(lambda it: trimmed(_read(it)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.text import table

    packages = written(write_packages(table(spark, sf_dir, "pages")))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
