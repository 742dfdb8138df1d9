"""WARC archives: a distributed writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.common import as_bytes, join_classes, slices
from twinsift.stash import Stash, partitions

MAGIC = b"\x1f\x8b\x08"
#: The last byte of a gzip member is the top byte of its length, zero below 16 MiB. Spark's text writer puts a
#: separator after each row, so rows are members without that byte and the separator is the byte.
LAST = b"\x00"
#: A whole gzip member of nothing; it follows members of 16 MiB and more, so that these end in a zero as well.
NOTHING = bytes.fromhex("1f8b080000000000000303000000000000000000")
#: Names that Spark's text reader would take for compressed as a whole.
CODED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(rb"([0-9a-f]{8})-([0-9a-f]{4})-8([0-9a-f]{3})-8([0-9a-f])")


def record_id(number: int) -> str:
    """A version 8 UUID that holds a 64-bit number."""
    h = f"{number & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}00-000000000000>"


def record_number(text: bytes | None) -> int | None:
    m = _ID.search(text or b"")
    if not m:
        return None
    n = int(b"".join(m.groups()), 16)
    return n - (1 << 64) if n >> 63 else n


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int) -> bytes:
    """One compressed record: a response, or a revisit of ``refers_to`` that leaves the payload out."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {record_id(page_id)}"] if page_id is not None else []
    head += [f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = squeeze.compress(data) + squeeze.flush()
    return out if out[-1:] == LAST else out + NOTHING


def write_archive(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> None:
    """Writes one record per row of ``pages(page_id, url, html)`` as gzip members into files under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest page_id is the response and
    rows with smaller ids revisit it. Null html is an empty payload, a null page_id gives a record without id that none
    refers to, repeated rows are records of their own, and no rows give no records. Which payloads repeat is found on digests only. The files are written by
    Spark's own writer, so ``path`` may be in any store and lost tasks leave nothing behind.
    """
    stash = Stash(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    short = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    again = short.where(F.col("size") >= least_bytes).groupBy("digest")
    again = again.agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stash.put(again, "repeated")
    revisits = join_classes(short.where(F.col("size") >= least_bytes), again, "digest", "n").where("page_id < refers_to")
    revisits = stash.put(revisits.select("page_id", "digest", "refers_to").distinct(), "revisits")
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()
            out = [member(i, u, h, r, date, level)[:-1] for i, u, h, r in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    made.write.option("lineSep", LAST.decode()).text(path)


def _decode(data: bytes) -> bytes | None:
    """The content of a whole gzip member, or ``None`` if it does not end yet."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(data)
    except zlib.error:
        return None
    return out if d.eof else None


def _begins(candidate: bytes) -> bool:
    """Whether a member that begins here decodes to a record's first line (or to nothing)."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(candidate, 16)
    except zlib.error:
        return False
    return out.startswith(b"WARC/") or (d.eof and not out)


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = (x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return {k.strip().lower(): v.strip() for k, v in lines}


def _whole(text: bytes | None) -> int | None:
    """A header's number, or ``None`` if there is none or it is no number."""
    return int(text) if text and text.isdigit() else None


def _digest(text: bytes) -> str | None:
    """A payload digest in hex, if it is SHA-1 in base 32 or hex; any other is left as it is written."""
    kind, _, value = text.rpartition(b":")
    if kind.lower() in (b"", b"sha1") and len(value) in (32, 40):
        try:
            return (base64.b32decode(value, casefold=True) if len(value) == 32 else bytes.fromhex(value.decode())).hex()
        except ValueError:
            pass
    return text.decode("utf-8", "replace") or None


def parse_records(data: bytes) -> Iterator[dict]:
    """Fields of the records of one decoded member, one after the other.

    The payload of a block of type ``application/http`` (or of unknown type, if it begins like one) is what follows
    its HTTP head; that of any other block is the block. A revisit has no payload: its size is that of its HTTP head's
    Content-Length, null without, and its digest the one that the record names. What is no record, or has no
    length, is one row of type damaged to the end of the member.
    """
    while data := data.lstrip(b"\r\n"):
        head, found, rest = data.partition(b"\r\n\r\n")
        fields = _fields(head)
        length = _whole(fields.get(b"content-length"))
        if not data.startswith(b"WARC/") or not found or length is None or length > len(rest):
            yield {"record_type": "damaged"}
            return
        block, data = rest[:length], rest[length:]
        media = fields.get(b"content-type", b"").lower()
        http, _, payload = block.partition(b"\r\n\r\n")
        if not (media.startswith(b"application/http") or not media and block.startswith(b"HTTP/")):
            http, payload = b"", block
        kind = fields.get(b"warc-type", b"").decode("utf-8", "replace") or "unknown"
        again = kind == "revisit"
        yield {
            "page_id": record_number(fields.get(b"warc-record-id")),
            "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
            "record_type": kind,
            "payload_bytes": _whole(_fields(http).get(b"content-length")) if again else len(payload),
            "payload_digest": _digest(fields.get(b"warc-payload-digest", b"")) if again else hashlib.sha1(payload).hexdigest(),
            "refers_to": record_number(fields.get(b"warc-refers-to")),
            "payload": None if again else payload,
        }


RECORD = [
    ("page_id", pa.int64(), "long"),
    ("url", pa.string(), "string"),
    ("record_type", pa.string(), "string"),
    ("payload_bytes", pa.int64(), "long"),
    ("payload_digest", pa.string(), "string"),
    ("refers_to", pa.int64(), "long"),
    ("payload", pa.binary(), "binary"),
]
PIECE = [("file", pa.string(), "string"), ("block", pa.int64(), "long"), ("nth", pa.int32(), "int"), ("piece", pa.binary(), "binary")]


def scan_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archive files under ``path``, and pieces of records that a split's edge cut.

    Spark deals byte ranges of the files to tasks and cuts them at the gzip magic; a task gets every candidate
    that starts inside its range, to its end. The magic may also occur inside a member: a candidate begins a
    record only if the one before it has ended, and at the start of a range only if its header decodes. What is
    left over at the edges of ranges has ``piece`` set and is put together by :func:`read_archive`.
    """
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    columns = RECORD + PIECE  # every record names its file as well

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        at, held, nth = None, b"", 0

        def left_over() -> None:
            nonlocal held, nth
            if held:
                out.append({"file": at[0], "block": at[1], "nth": nth, "piece": held})
                nth += 1
            held = b""

        for batch in slices(batches, 256):
            for value, *where in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if where != at:
                    left_over()
                    at, first, nth = where, where[1] == 0, 0
                    head = True
                if first:  # what precedes the first magic of a file is no member
                    first = False
                    continue
                data = MAGIC + value
                if held:
                    data = held + data
                elif head and not _begins(data):
                    out.append({"file": at[0], "block": at[1], "nth": nth, "piece": data})
                    nth += 1
                    continue
                head = False
                done = _decode(data)
                held = data if done is None else b""
                for record in parse_records(done or b""):
                    record |= {"file": at[0]}
                    out.append(record if payloads else record | {"payload": None})
            yield _batch(out, columns)
            out = []
        left_over()
        if out:
            yield _batch(out, columns)

    return lines.mapInArrow(run, ", ".join(f"{n} {s}" for n, _, s in columns))


def ranges(files: DataFrame, size: int) -> DataFrame:
    """``(file, first, last)``: byte ranges of ``files(file, length)``."""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    return files.where("length > 0").select("file", cuts.alias("first"), "length").select("file", "first", F.least(F.col("first") + size, "length").alias("last"))


def members_in(open_file, first: int, last: int, chunk: int = 1 << 20) -> Iterator[bytes | None]:
    """Decoded members of a gzip file that start in ``[first, last)``; ``None`` stands for a damaged one.

    A candidate is where the magic stands. In front of the first member, and behind a damaged one, it begins a member
    only if its header decodes to a record's; each whole member then says where the next begins.
    """
    with open_file() as f:
        at, held, sure = first, b"", False
        f.seek(first)

        def more() -> bool:
            nonlocal held
            data = f.read(chunk)
            held += data
            return bool(data)

        while at < last:
            while len(held) < chunk // 2 and more():
                pass
            found = held.find(MAGIC)
            if found < 0:  # the magic may stand across the edge of what is held
                skip = max(1, len(held) - len(MAGIC) + 1)
                if len(held) < len(MAGIC) and not more():
                    return
                at, held, sure = at + skip, held[skip:], False
                continue
            at, held, sure = at + found, held[found:], sure and not found
            if at >= last:
                return
            while len(held) < 512 and more():
                pass
            if not sure and not _begins(held[:512]):
                at, held = at + 1, held[1:]
                continue
            d, out, data = zlib.decompressobj(31), [], held
            try:
                out.append(d.decompress(data))
                while not d.eof and (data := f.read(chunk)):
                    held += data
                    out.append(d.decompress(data))
            except zlib.error:
                pass
            if d.eof:
                size = len(held) - len(d.unused_data)
                yield b"".join(out)
                at, held, sure = at + size, held[size:], True
            else:
                yield None
                at, held, sure = at + 1, held[1:], False


def scan_ranges(files: DataFrame, payloads: bool, size: int = 64 << 20) -> DataFrame:
    """Records, and their ``file``, of gzip files ``files(file, length)`` by byte ranges that tasks open themselves, in any store that Arrow opens.

    For names that Spark's text reader would decompress as a whole, like ``.warc.gz``. A member may hold several
    records, all of which belong to the range in which it starts. A member that cannot be read is a
    row of type damaged; empty files and no files give no rows.
    """
    columns = RECORD + PIECE[:1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, path = pa.fs.FileSystem.from_uri(name)
                out = []
                for data in members_in(lambda: store.open_input_file(path), first, last):
                    for record in [{"record_type": "damaged"}] if data is None else parse_records(data):
                        record |= {"file": name}
                        out.append(record if payloads else record | {"payload": None})
                        if len(out) == 64:
                            yield _batch(out, columns)
                            out = []
                yield _batch(out, columns)

    spark = files.sparkSession
    cut = ranges(files, size)
    return cut.repartition(max(1, min(cut.count(), 64 * partitions(spark))), "file", "first").mapInArrow(run, ", ".join(f"{n} {s}" for n, _, s in columns))


def _batch(rows: list[dict], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t, _ in columns], [n for n, _, _ in columns])


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archive files under ``path``: the columns of ``RECORD``.

    Each record belongs to the byte range in which it starts. Pieces at the edges of ranges are few (a chance
    magic inside compressed data) and are joined per file. A revisit's size and digest are those of the payload
    it stands for; a null digest or number is one that the archive does not give. An empty archive gives no rows; any
    file that has bytes but no record is an error. What is no record inside a member is a row of type damaged.

    Files whose suffix names a codec (``.gz``) are read by :func:`scan_ranges`: a damaged member, or one that the end
    of the file cuts, is a row of ``record_type`` damaged with nulls, and reading goes on behind it. In files that
    :func:`write_archive` makes, with no such suffix, a damaged member ends the read with an error.
    """
    stash = Stash(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = stash.put(files.select(F.col("_metadata.file_path").alias("file"), "length").where("length > 0"), "files")
    names = [n for n, _, _ in RECORD]
    coded = bool(files.where(F.col("file").rlike(CODED)).limit(1).count())
    scanned = stash.put(scan_ranges(files, payloads) if coded else scan_archive(spark, path, payloads), "scanned")
    bare = files.join(scanned.select("file").distinct(), "file", "left_anti").limit(1).collect()
    if bare:
        raise ValueError(f"no record in the file {bare[0]['file']}")
    if coded:
        return scanned.select(*names)

    def stitch(pieces: pd.DataFrame) -> pd.DataFrame:
        out, held = [], b""
        for piece in pieces.sort_values(["block", "nth"])["piece"]:
            held = held + piece if held else piece
            done = _decode(held)
            if done is not None:
                held = b""
                out.extend(parse_records(done))
        if held:
            raise ValueError(f"the archive file {pieces['file'].iloc[0]} ends inside a record")
        found = pd.DataFrame(out, columns=names)
        return found.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    schema = ", ".join(f"{n} {s}" for n, _, s in RECORD)
    edges = scanned.where("piece is not null").select("file", "block", "nth", "piece").groupBy("file").applyInPandas(stitch, schema)
    return scanned.where("piece is null").select(*names).unionByName(edges)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Writes ``pages`` as an archive in the shared folder and reads it back without the payloads.

    One row ``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per row of ``pages``. Null html
    is an empty payload; a null page_id comes back null and never is the response of others; repeated rows
    are written each time; extra columns are ignored; no rows give no rows.
    """
    spark = pages.sparkSession
    path = Stash(spark).path("archive")
    write_archive(pages, path, least_bytes)
    return read_archive(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
