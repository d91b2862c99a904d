"""WARC records in ZIP-packaged archives: writing, and reading without extraction.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdx``, one line per record with its offset and length. The reader takes the end of the file, follows
the ZIP64 locator where there is one, walks the central directory in bounded blocks, finds where the members' bytes begin
and reads the index; records are then fetched by range, several neighbours at once. An archive is opened by one task, but
its records are dealt over all tasks in blocks of ``BLOCK_BYTES``. Archives without an index are scanned from record to
record; compressed members, broken directories and cut files raise ``ValueError``.

Of records with equal payloads of at least ``least_bytes`` bytes that with the largest key is a response, the others
revisit it and hold no payload. Equal payloads meet by their SHA-256. A group with a thousandth of all such copies or more
(so at most a thousand groups) is looked up in the task; its rows don't meet in the join.

Archives are written by tasks through ``pyarrow.fs`` below the shared folder, under a name of their own per attempt; the
manifest, a table that Spark commits, lists those of successful attempts only. Records are streamed, and an archive is
closed at ``ARCHIVE_BYTES`` bytes or ``ARCHIVE_RECORDS`` records.

Null or empty html: a response of 0 bytes. A null key names nothing: such a row is a response and never revisited, unless
all its copies have no key either; then all are responses. Rows with the same key and payload are each written; those with the
largest key are all responses. A null url leaves the target out. Control characters and blanks in a url are
percent-encoded. An empty table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import task_count
from .common import Scratch

LEAST_BYTES = 1000
#: Size and records of an archive; bytes of records that a task reads, and that it fetches at once; bytes of directory or index
#: read at once.
ARCHIVE_BYTES, ARCHIVE_RECORDS, TASK_BYTES, BLOCK_BYTES, READ_BYTES = 1 << 30, 200_000, 64 << 20, 4 << 20, 1 << 20
#: Copies of one payload above one in so many of all copies are looked up in the task.
HOT_SHARE = 1000
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

# Fixed values of the ZIP format: signatures, and what a 16- or 32-bit field holds if the value is in the ZIP64 one.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

ReadAt = Callable[[int, int], bytes]


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path behind a folder or file that Spark names."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path if parts.scheme else uri
    if parts.scheme in ("s3a", "s3n"):
        uri = "s3" + uri[3:]
    return pafs.FileSystem.from_uri(uri)


class StoredZip:
    """Writes stored members to a stream that can only be appended to; sizes follow the members' bytes."""

    def __init__(self, out, full32: int = FULL32, full16: int = FULL16):
        self.out, self.full32, self.full16 = out, full32, full16
        self.at, self.entries = 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.start, self.crc, self.size = raw, self.at, 0, 0
        # flags: sizes follow, names are UTF-8; the ZIP64 field makes the sizes that follow 64-bit numbers
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", DESCRIPTOR, self.crc, self.size, self.size))
        self.entries.append((self.name, self.start, self.crc, self.size))

    def close(self) -> None:
        directory = self.at
        for name, start, crc, size in self.entries:
            wide = [v for v in (size, size, start) if v >= self.full32]
            short = lambda v: FULL32 if v >= self.full32 else v
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            head = (CENTRAL, 45, 45, 0x0808, 0, 0, 33, crc, short(size), short(size), len(name), len(extra), 0, 0, 0, 0, short(start))
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", *head) + name + extra)
        end, n = self.at, len(self.entries)
        length = end - directory
        if max(end, length) >= self.full32 or n >= self.full16:
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, directory))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, directory, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int

    def begins(self, read_at: ReadAt) -> int:
        """Offset of the member's first byte, which its local header tells."""
        head = read_at(self.header, 30)
        if len(head) < 30 or struct.unpack_from("<I", head)[0] != LOCAL:
            raise ValueError(f"no local header of {self.name} at {self.header}")
        name, extra = struct.unpack_from("<HH", head, 26)
        return self.header + 30 + name + extra


def _end_of_directory(read_at: ReadAt, size: int) -> tuple[int, int, int, int]:
    """(entries, length and offset of the directory, bytes that stand before the archive itself)."""
    start = max(0, size - 22 - FULL16)
    tail = read_at(start, size - start)
    at = len(tail) - 22
    while at >= 0:
        at = tail.rfind(struct.pack("<I", END), 0, at + 4)
        if at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    n, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end = start + at
    locator = read_at(end - 20, 20) if end >= 20 else b""
    if len(locator) == 20 and struct.unpack_from("<I", locator)[0] == LOCATOR64:
        place = struct.unpack_from("<Q", locator, 8)[0]
        record = read_at(place, 56)
        if len(record) < 56 or struct.unpack_from("<I", record)[0] != END64:
            raise ValueError("the ZIP64 locator leads nowhere")
        n, length, offset = struct.unpack_from("<QQQ", record, 32)
        end = place
    before = end - length - offset
    if before < 0:
        raise ValueError("a ZIP directory longer than its file")
    return n, length, offset, before


def members(read_at: ReadAt, size: int) -> Iterator[Member]:
    """Members in the order of the central directory, which is read in blocks."""
    n, length, offset, before = _end_of_directory(read_at, size)
    at, held, stop = before + offset, b"", before + offset + length
    for _ in range(n):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            if at >= stop:
                raise ValueError("the ZIP directory ends within an entry")
            block = read_at(at, min(READ_BYTES, stop - at))
            if not block:
                raise ValueError("the file ends within its ZIP directory")
            held, at = held + block, at + len(block)
        if struct.unpack_from("<I", held)[0] != CENTRAL:
            raise ValueError("no entry in the ZIP directory where one is due")
        method = struct.unpack_from("<H", held, 10)[0]
        packed, whole, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", held, 20)
        header = struct.unpack_from("<I", held, 42)[0]
        name, extra = held[46 : 46 + n_name], held[46 + n_name : 46 + n_name + n_extra]
        held = held[46 + n_name + n_extra + n_note :]
        place = 0
        while place + 4 <= len(extra):
            kind, n_field = struct.unpack_from("<HH", extra, place)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n_field // 8}Q", extra, place + 4))
                whole = next(wide) if whole == FULL32 else whole
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            place += 4 + n_field
        yield Member(name.decode("utf-8", "replace"), method, packed, before + header)


# -- records ---------------------------------------------------------------------------------------------------------


def record(kind: str, key: str, url: str | None, html: str, date: str, refers_to: str | None, digest: bytes) -> bytes:
    """One WARC record. A revisit holds the head of the answer, whose length is that of the full payload, but no payload."""
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:row:{quote(key, safe='')}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri_of(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *([] if refers_to is None else [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:row:{quote(refers_to, safe='')}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def uri_of(url: str) -> str:
    return "".join(quote(c) if c <= " " or "\x7f" <= c <= "\xa0" else c for c in url)


def parse(data: bytes) -> dict:
    """Fields of one record; what a response or revisit says about its payload comes from the answer it holds."""
    head, mark, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(lines[1:])
    size = int(fields.get("content-length", -1))
    if size < 0 or size > len(block):
        raise ValueError("a WARC record that is cut or has no length")
    block, kind = block[:size], fields.get("warc-type")
    payload, length = block, size
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":
            length = int(_fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length", 0))
    said = _digest(fields.get("warc-payload-digest"))
    found = hashlib.sha1(payload).hexdigest() if kind != "revisit" else said
    return {
        "record_type": kind, "row_key": _key(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "payload_bytes": length, "payload_digest": found, "verified": None if kind == "revisit" or said is None else said == found,
        "refers_to_key": _key(fields.get("warc-refers-to")), "payload": None if kind == "revisit" else payload,
    }


def _fields(lines: list[str]) -> dict[str, str]:
    out, last = {}, None
    for line in lines:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _key(record_id: str | None) -> str | None:
    """The key in a record's name; other tools' names are kept as they are."""
    if record_id is None:
        return None
    inner = record_id.strip("<>")
    return unquote(inner.removeprefix("urn:row:")) or None if inner.startswith("urn:row:") else inner


def _digest(text: str | None) -> str | None:
    """Hexadecimal SHA-1 of a digest field in base 32 or 16; None for other kinds."""
    kind, _, value = (text or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        raw = base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


# -- writing ---------------------------------------------------------------------------------------------------------


class _Archive:
    """One archive being written."""

    def __init__(self, folder: str, level: int):
        files, path = store(folder)
        files.create_dir(path, recursive=True)
        self.uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        self.out = files.open_output_stream(f"{path}/{self.uri.rsplit('/', 1)[1]}")
        self.zip, self.level, self.lines, self.n = StoredZip(self.out), level, [], 0
        self.zip.begin(RECORDS)

    def add(self, row: tuple, date: str) -> None:
        key, url, html, refers_to = row
        digest = hashlib.sha1(html.encode()).digest()
        data = record("response" if refers_to is None else "revisit", key or "", url, html, date, refers_to, digest)
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = pack.compress(data) + pack.flush()
        about = {"url": url, "digest": "sha1:" + base64.b32encode(digest).decode(), "offset": str(self.zip.size), "length": str(len(packed)), "filename": RECORDS.rsplit("/", 1)[1]}
        self.lines.append(f"{uri_of(url or '-')} {date.translate({45: None, 58: None, 84: None, 90: None})} {json.dumps(about)}\n")
        self.zip.write(packed)
        self.n += 1

    def close(self) -> dict:
        self.zip.end()
        self.zip.begin(INDEX)
        for line in sorted(self.lines):
            self.zip.write(line.encode())
        self.zip.end()
        self.zip.close()
        self.out.close()
        return {"archive": self.uri, "n_records": self.n, "n_bytes": self.zip.at}


def revisits(pages: DataFrame, scratch: Scratch, least_bytes: int) -> DataFrame:
    """``pages`` (row_key, url, html) with refers_to: the largest key among equal payloads, null for that row and for all that
    revisit nothing."""
    rows = pages.withColumn("_n", F.octet_length("html")).withColumn("_same", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.filter(F.col("_n") >= least_bytes)
    copies = large.groupBy("_same").agg(F.max("row_key").alias("_keeper"), F.count("*").alias("_copies"))
    copies = scratch.keep(copies.filter("_copies > 1 and _keeper is not null"), "copies")
    total = copies.agg(F.sum("_copies")).first()[0] or 0
    hot = F.col("_copies") * HOT_SHARE >= total
    few = copies.filter(hot).select("_same", F.col("_keeper").alias("_hot"))  # at most HOT_SHARE rows
    rows = rows.join(F.broadcast(few), "_same", "left")
    # rows that need no further look get a name of their own, so they are dealt evenly
    settled = F.col("_hot").isNotNull() | (F.col("_n") < least_bytes)
    rows = rows.withColumn("_meet", F.when(settled, F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("_same")))
    rest = copies.filter(~hot).select(F.col("_same").alias("_meet"), "_keeper")
    keeper = F.coalesce("_hot", "_keeper")
    refers = F.when((F.col("_n") >= least_bytes) & (F.col("row_key") < keeper), keeper)
    return rows.join(rest, "_meet", "left").select("row_key", "url", "html", refers.alias("refers_to"))


def write_pages(
    pages: DataFrame, scratch: Scratch, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES,
    date: str = "1970-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS,
) -> DataFrame:
    """Write one record per row; the manifest: archive (its place), n_records, n_bytes."""
    folder = f"{scratch.root}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("row_key", "url", "html", "refers_to")), strict=True):
                archive = archive or _Archive(folder, level)
                archive.add(row, date)
                if archive.zip.at >= archive_bytes or archive.n >= archive_records:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    chosen = pages.select(F.col(key).alias("row_key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = revisits(chosen, scratch, least_bytes)
    rows = rows.select(F.col("row_key").cast("string").alias("row_key"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    manifest = scratch.keep(rows.mapInArrow(run, "archive string, n_records bigint, n_bytes bigint"), "manifest")
    scratch.drop("copies")
    return manifest


# -- reading ---------------------------------------------------------------------------------------------------------


def _opened(uri: str) -> tuple[pa.NativeFile, ReadAt]:
    files, path = store(uri)
    handle = files.open_input_file(path)

    def read_at(offset: int, size: int) -> bytes:
        handle.seek(offset)
        return handle.read(size)

    return handle, read_at


def _index_lines(read_at: ReadAt, begin: int, size: int) -> Iterator[bytes]:
    at, held = begin, b""
    while at < begin + size:
        block = read_at(at, min(READ_BYTES, begin + size - at))
        if not block:
            raise ValueError("the file ends within its index")
        at += len(block)
        *lines, held = (held + block).split(b"\n")
        yield from lines
    if held:
        yield held


def _scanned(read_at: ReadAt, begin: int, size: int, name: str) -> Iterator[tuple[int, int]]:
    """(offset, length) of every record of a member without an index."""
    at, end = begin, begin + size
    while at < end:
        start = at
        if name.endswith(".gz"):
            unpack = zlib.decompressobj(31)
            while not unpack.eof:
                block = read_at(at, min(READ_BYTES, end - at))
                if not block:
                    raise ValueError("the file ends within a record")
                unpack.decompress(block)
                at += len(block) - len(unpack.unused_data)
        else:
            held = b""
            while b"\r\n\r\n" not in held:
                block = read_at(at + len(held), min(READ_BYTES, end - at - len(held)))
                if not block:
                    raise ValueError("the file ends within a record")
                held += block
            head = held.index(b"\r\n\r\n")
            at += head + 4 + int(_fields(held[:head].decode("utf-8", "replace").split("\r\n")[1:])["content-length"]) + 4
        yield start, at - start


def places(uri: str) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record of an archive, in the order of the offsets per member."""
    handle, read_at = _opened(uri)
    with handle:
        found = [m for m in members(read_at, handle.size()) if m.name.startswith(("archive/", "indexes/")) and not m.name.endswith("/")]
        for m in found:
            if m.method and m.name.endswith((".warc", ".warc.gz", ".cdx", ".cdxj")):
                raise ValueError(f"{uri}: {m.name} is compressed, not stored")
        begin = {m.name.rsplit("/", 1)[1]: (m.begins(read_at), m.size) for m in found if m.name.endswith((".warc", ".warc.gz"))}
        listed: dict[str, list[tuple[int, int]]] = {}
        for m in found:
            if m.name.endswith((".cdx", ".cdxj")):
                for line in _index_lines(read_at, m.begins(read_at), m.size):
                    about = json.loads(line[line.index(b"{") :])
                    listed.setdefault(about["filename"], []).append((int(about["offset"]), int(about["length"])))
        for name, (start, size) in begin.items():
            if name in listed:
                for offset, length in sorted(set(listed[name])):
                    if offset + length > size:
                        raise ValueError(f"{uri}: the index names bytes beyond {name}")
                    yield start + offset, length
            else:
                yield from _scanned(read_at, start, size, name)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring records of an archive, as many as fit one read."""

    def block(uri: str, held: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"archive": uri, "offsets": [o for o, _ in held], "lengths": [n for _, n in held]}],
            pa.schema([("archive", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]))

    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            held: list[tuple[int, int]] = []
            for offset, length in places(uri):
                if held and offset + length - held[0][0] > BLOCK_BYTES:
                    yield block(uri, held)
                    held = []
                held.append((offset, length))
            if held:
                yield block(uri, held)


FIELDS = [
    ("record_type", pa.string()), ("row_key", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("verified", pa.bool_()), ("refers_to_key", pa.string()), ("payload", pa.binary()),
]


def read_records(archives: DataFrame, *, payload: bool = False) -> DataFrame:
    """Records of all archives (a column ``archive``): archive, record_type, row_key, target_uri, date, payload_bytes,
    payload_digest (of the bytes read; a revisit's is that of its field), verified (whether digest and field agree; null
    where one is missing), refers_to_key and, with ``payload``, the payload."""
    schema = pa.schema([("archive", pa.string()), *(f for f in FIELDS if payload or f[0] != "payload")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                handle, read_at = _opened(row["archive"])
                with handle:
                    first, last = row["offsets"][0], row["offsets"][-1] + row["lengths"][-1]
                    data = read_at(first, last - first)
                if len(data) < last - first:
                    raise ValueError(f"{row['archive']}: the file ends within a record")
                out = []
                for offset, length in zip(row["offsets"], row["lengths"], strict=True):
                    raw = data[offset - first : offset - first + length]
                    out.append({"archive": row["archive"], **parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)})
                yield pa.RecordBatch.from_pylist(out, schema)

    blocks = archives.select("archive").mapInArrow(_blocks, "archive string, offsets array<bigint>, lengths array<bigint>")
    # a row of blocks is small and its records are not, so the number of tasks follows the archives' size
    size = archives.agg(F.sum("n_bytes")).first()[0] if "n_bytes" in archives.columns else 0
    tasks = max(task_count(archives.sparkSession), -(-(size or 0) // TASK_BYTES))
    dealt = blocks.repartition(tasks, F.xxhash64("archive", F.col("offsets")[0]))
    kinds = {"binary": "binary", "bool": "boolean", "int64": "bigint", "string": "string"}
    return dealt.mapInArrow(run, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema))
