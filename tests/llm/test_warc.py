import glob
import gzip
import hashlib
import os
import random
import zlib

import pytest

from tests.oracle import connect, same
from twinsift.llm import queries
from twinsift.llm import warc as w
from twinsift.stash import Stash

SCHEMA = "page_id long, url string, html string, digest string"


def pages():
    rng = random.Random(9)
    noise = lambda n: "".join(chr(rng.randint(32, 0x2FF)) for _ in range(n))
    twin = noise(1200)
    rows = [(i, f"http://a.net/{i}", noise(rng.randint(0, 4000))) for i in range(40)]
    rows += [(100 + i, None, twin) for i in range(5)] + [(200 + i, "http://b.net/\r\nx y", "short") for i in range(3)]
    rows += [(300, "u", None), (301, "u", ""), (302, "u", "x" * 999), (303, "u", "x" * 999), (304, "u", "x" * 1000), (305, "u", "x" * 1000)]
    rows += [(-5, "u", twin), (None, "u", twin), (104, None, twin), (2**62, "u", "big id"), (400, "u", "é" * 500), (401, "u", "é" * 500)]
    return [(*r, "x") for r in rows]


def brute(rows):
    top = {}
    for i, _, h, _ in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and i is not None and i < top[h or ""]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = w.round_trip(spark.createDataFrame(pages(), SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(pages())
    assert w.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("split", ["64k", "3000", "700"])
def test_any_split_size(spark, split):
    path = Stash(spark).path("archive")
    w.write_archive(spark.createDataFrame(pages(), SCHEMA).coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = w.read_archive(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    payloads = {(i, (h or "").encode()) for i, _, h, _ in pages()}
    assert len(got) == len(pages())
    for r in got:
        if r["record_type"] == "response":
            assert (r["page_id"], bytes(r["payload"])) in payloads
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None


def test_chance_magic_at_edges_of_ranges(spark, tmp_path):
    """Members that hold the magic inside stored (uncompressed) blocks, read in tiny ranges."""
    rng = random.Random(2)
    out = b""
    for i in range(30):
        body = b"".join(rng.randbytes(rng.randint(0, 40)) + w.MAGIC * rng.randint(0, 3) for _ in range(40))
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {w.record_id(i)}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        out += c.compress(head + block + b"\r\n\r\n") + c.flush()
    (tmp_path / "a.dat").write_bytes(out)
    for split in ("100", "999", "20000", "10m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = w.read_archive(spark, f"file://{tmp_path}").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(r["page_id"] for r in got) == list(range(30))


def as_foreign(spark, tmp_path, rows):
    """The records of our own archive as one ``.warc.gz`` file, with its members in order."""
    path = f"{tmp_path}/own"
    w.write_archive(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{path}")
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))
    os.makedirs(f"{tmp_path}/in")
    return f"{tmp_path}/in/a.warc.gz", data


@pytest.mark.parametrize("size", [700, 5000, 64 << 20])
def test_foreign_suffix(spark, tmp_path, monkeypatch, size):
    name, data = as_foreign(spark, tmp_path, pages())
    open(name, "wb").write(data)
    monkeypatch.setattr(w.scan_ranges, "__defaults__", (size,))
    got = w.read_archive(spark, f"file://{tmp_path}/in", payloads=False).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == brute(pages())


def test_damaged_member_is_a_row(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 50, "x") for i in range(6)]
    name, data = as_foreign(spark, tmp_path, rows)
    starts = [i for i in range(len(data)) if data.startswith(w.MAGIC, i)]
    third = starts[len(starts) // 2]
    broken = data[: third + 20] + b"\xff" * 20 + data[third + 40 :]
    open(name, "wb").write(broken[:-9])
    got = w.read_archive(spark, f"file://{tmp_path}/in").collect()
    assert sorted(r["record_type"] for r in got).count("damaged") == 2 and len(got) == 6
    assert all(r["page_id"] is None for r in got if r["record_type"] == "damaged")


def record(kind, block, media="application/http; msgtype=response", extra="", length=True):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}" + (f"Content-Type: {media}\r\n" if media else "")
    return (head + (f"Content-Length: {len(block)}\r\n" if length else "") + "\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("name", ["x.warc.gz", "x.dat"])
def test_foreign_records(spark, tmp_path, name):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    sha = hashlib.sha1(b"abc").hexdigest()
    together = [record("response", http + b"abc"), record("resource", b"x\r\n\r\ny" * 2, "text/plain"), record("warcinfo", b"a: b\r\n", "application/warc-fields")]
    together += [record("revisit", http, extra=f"WARC-Payload-Digest: sha1:{sha.upper()}\r\n"), record("revisit", b"", extra="WARC-Payload-Digest: sha256:00ff\r\n")]
    together += [record("revisit", b""), record("response", http + b"q", media="")]
    alone = record("response", http + b"last")
    lost = record("response", http + b"abc") + record("response", b"none", length=False) + record("response", http)
    (tmp_path / name).write_bytes(b"".join(map(gzip.compress, (b"".join(together), alone, lost))))
    got = [(r["record_type"], r["payload_bytes"], r["payload_digest"], r["payload"] and bytes(r["payload"])) for r in w.read_archive(spark, f"file://{tmp_path}").collect()]
    plain = lambda kind, p: (kind, len(p), hashlib.sha1(p).hexdigest(), p)
    want = [plain("response", b"abc"), plain("resource", b"x\r\n\r\ny" * 2), plain("warcinfo", b"a: b\r\n"), ("revisit", 3, sha, None)]
    want += [("revisit", None, "sha256:00ff", None), ("revisit", None, None, None), plain("response", b"q"), plain("response", b"last")]
    assert sorted(got, key=str) == sorted([*want, plain("response", b"abc"), ("damaged", None, None, None)], key=str)


@pytest.mark.parametrize("suffix", [".warc.gz", ".dat"])
def test_every_file_is_judged(spark, tmp_path, suffix):
    (tmp_path / f"good{suffix}").write_bytes(gzip.compress(record("resource", b"x", "text/plain")))
    (tmp_path / f"bad{suffix}").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="no record in the file .*bad"):
        w.read_archive(spark, f"file://{tmp_path}")


@pytest.mark.parametrize("name", ["x.warc", "x.warc.gz"])
def test_bytes_without_a_record_are_an_error(spark, tmp_path, name):
    (tmp_path / name).write_bytes(b"no archive at all " * 10)
    with pytest.raises(ValueError, match="no record"):
        w.read_archive(spark, f"file://{tmp_path}")


def test_files_are_plain_multi_member_gzip(spark, tmp_path):
    rows = [(1, "u", "y" * (17 << 20), "x"), (2, "u", "z" * 10, "x")]
    path = f"{tmp_path}/out"
    w.write_archive(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{path}")
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 2 and os.path.exists(f"{path}/_SUCCESS")
    got = w.read_archive(spark, f"file://{path}").collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(1, 17 << 20), (2, 10)]


def test_record_numbers():
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        assert w.record_number(w.record_id(n).encode()) == n


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    same(queries.QUERIES["op8_warc"](spark, folder), queries.SQL["op8_warc"], connect(folder))
