"""WARC records written, read back, and salvaged from damaged archives."""

import gzip
import hashlib
import re

import pytest

from cadenza.llm import warc
from cadenza.llm.common import Scratch


def page(i, size=40):
    return record_of(i, (f"<p>{i}</p>" * size).encode())


def record_of(i, payload):
    return warc.record("response", f"id-{i}", i, f"http://x/{i}", hashlib.sha1(payload).digest(), len(payload), payload, "2024-01-01T00:00:00Z")


def member(i):
    return warc.member(page(i)) + b"\0"


def found(data):
    """[(page or reason of the gap, start, size)]; the parts must tile the data."""
    out = list(warc.salvaged(data))
    at = 0
    for start, size, _, _ in out:
        assert start == at
        at += size
    assert at == len(data)
    return [(int(r["x-page-id"]) if r else why, start, size) for start, size, why, r in out]


def test_a_file_is_members_alone():
    data = b"".join(member(i) for i in range(5))
    assert gzip.decompress(data) == b"".join(page(i) for i in range(5))
    assert [f[0] for f in found(data)] == [0, 1, 2, 3, 4]


def test_long_members_end_with_an_empty_one():
    data = b"x" * ((1 << 24) + 5)
    out = warc.member(data) + b"\0"
    assert gzip.decompress(out) == data and out.endswith(warc._EMPTY)


@pytest.mark.parametrize("kind", ["gzip", "plain", "mixed"])
def test_later_records_survive_damage(kind):
    parts = [member(i) if kind == "gzip" or kind == "mixed" and i % 2 else page(i) for i in range(6)]
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    data = bytearray(b"".join(parts))
    assert [f[0] for f in found(bytes(data))] == list(range(6))
    hurt = bytearray(data)
    middle = starts[2] + len(parts[2]) // 2
    hurt[middle] ^= 0xFF  # in member or block
    got = found(bytes(hurt))
    assert [f[0] for f in got if isinstance(f[0], int)] == [0, 1, 3, 4, 5]
    assert [f[1:] for f in got if isinstance(f[0], str)] == [(starts[2], len(parts[2]))]
    cut = bytes(data[: starts[3] - 9] + data[starts[3] :])  # the end of record 2 is missing
    assert [f[0] for f in found(cut) if isinstance(f[0], int)] == [0, 1, 3, 4, 5]
    noise = bytes(data[: starts[1]]) + b"garbage \x1f\x8b\x08 WARC/1.0\r\n" * 3 + bytes(data[starts[1] :])
    got = found(noise)
    assert [f[0] for f in got if isinstance(f[0], int)] == list(range(6)) and sum(isinstance(f[0], str) for f in got) == 1
    short = bytes(data[:-3])
    assert [f[0] for f in found(short) if isinstance(f[0], int)] == [0, 1, 2, 3, 4] and isinstance(found(short)[-1][0], str)


def test_every_check_is_made():
    good = page(1)
    for old, new, why in [
        (b"WARC/1.1", b"WARC/9.1", "version"), (b"\r\nWARC-Target", b"9\r\nWARC-Target", "length"), (b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A", "block digest"),
        (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A", "payload digest"), (b"WARC-Date:", b"WARC-Date", "colon"),
    ]:
        assert old in good
        (what, start, size), *_ = found(good.replace(old, new, 1))
        assert isinstance(what, str) and why in what and (start, size) == (0, len(good.replace(old, new, 1)))


def test_payloads_that_look_like_records():
    inner = record_of(7, b"WARC/1.1\r\n\r\n\r\n\x1f\x8b\x08" + page(8))
    assert [f[0] for f in found(inner + page(9))] == [7, 9]
    assert found(b"") == []


def plain(pages):
    """pages: (page_id, url, html)."""
    groups = {}
    for n, (i, _, h) in enumerate(pages):
        groups.setdefault((h or "").encode(), []).append((i is not None, i or 0, n))
    out = []
    for n, (i, _, h) in enumerate(pages):
        data = (h or "").encode()
        top = max(groups[data])
        again = len(data) >= 1000 and (i is not None, i or 0, n) != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", (top[1] if top[0] else None) if again else None))
    return out


def test_archived(spark):
    long = "é" * 600
    pages = [
        (1, "http://a/1", long), (5, "http://a/5?x=é y", long), (3, None, long), (None, "u", long), (4, "u", "short"), (9, "u", "short"), (6, "u", None), (7, "", ""), (8, "u", "x" * 999),
        (10, "u", "x" * 999), (11, "u\r\nX-Page-ID: 3", "y" * 1000), (11, "u\r\nX-Page-ID: 3", "y" * 1000), (None, None, "z" * 2000), (None, None, "z" * 2000), (12, "u", "w" * (17 << 20))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.archived(df.selectExpr("*", "1 AS key", "2 AS top", "3 AS payload", "4 AS row"))
    assert sorted(tuple(map(str, r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == sorted(tuple(map(str, w)) for w in plain(pages))
    assert warc.archived(df.limit(0)).count() == 0


def test_texts_come_back_and_gaps_are_logged(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<p>{'é' * i}</p>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    path = f"{tmp_path}/w"
    warc.write(df, path, Scratch(spark, "t"))
    got = warc.read(spark, path)
    assert {(r.page_id, r.target, bytes(r.payload).decode()) for r in got.collect()} == set(pages)
    files = sorted((tmp_path / "w").glob("part-*"))
    data = bytearray(files[0].read_bytes())
    parts = list(warc.salvaged(bytes(data)))
    start, size = parts[3][:2]
    data[start + size // 2] ^= 0x55
    (tmp_path / "w2").mkdir()
    (tmp_path / "w2" / "a.warc.gz").write_bytes(bytes(data))
    (tmp_path / "w2" / "b.warc").write_bytes(gzip.decompress(files[1].read_bytes()))
    got = warc.read(spark, f"{tmp_path}/w2").collect()
    gaps = [(re.sub(".*/", "", r.path), r.start, r.size) for r in got if r.gap]
    assert gaps == [("a.warc.gz", start, size)]
    assert len([r for r in got if not r.gap]) == 39
