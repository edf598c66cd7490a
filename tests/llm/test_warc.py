"""WARC round trip and salvage of damaged archives."""

import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest

from tidemark.llm import warc
from tidemark.llm.files import create
from tidemark.session import scratch_dir

SCHEMA = "page_id long, url string, html string, type string, offset int"


def payload(i):
    return (f"<p>{i}</p>" * (1 + i % 40)).encode()


def raw_record(i):
    p = payload(i)
    return warc.record(i, f"http://x.example/{i}", p, hashlib.sha256(p).hexdigest(), None)


def parts(n, zipped):
    return [gzip.compress(raw_record(i)) if zipped else raw_record(i) for i in range(n)]


def salvage(data):
    return list(warc.salvage(pa.PythonFile(io.BytesIO(data), mode="r")))


def ids(found):
    return [int(h["warc-record-id"][10:-1]) for _, _, reason, h, _ in found if reason is None]


def check_cover(found, size):
    """Records and gaps follow each other and cover the file."""
    at = 0
    for offset, length, *_ in found:
        assert offset == at
        at += length
    assert at == size


@pytest.mark.parametrize("zipped", [True, False])
def test_whole_files(zipped):
    data = b"".join(parts(20, zipped))
    found = salvage(data)
    assert ids(found) == list(range(20)) and all(f[2] is None for f in found)
    check_cover(found, len(data))
    assert salvage(b"") == []


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_later_records_are_recovered(zipped, seed):
    """Whatever happens to one record, all records before and after it come back."""
    rng = random.Random(seed)
    p = parts(9, zipped)
    bad = rng.randrange(9)
    hurt = bytearray(p[bad])
    kind = seed % 4
    if kind == 0:
        # Plain headers carry no digest of their own, so only the block is hurt there.
        at = rng.randrange(len(hurt) // 3 if zipped else hurt.index(b"HTTP/1.1"), len(hurt) - 8)
        hurt[at : at + 4] = bytes(b ^ 0x5A for b in hurt[at : at + 4])
    elif kind == 1:
        del hurt[rng.randrange(20, len(hurt) - 1) :]
    elif kind == 2:
        hurt = bytearray(rng.randbytes(700)) + b"\x1f\x8b\x08 no member WARC/1. no record "
    else:
        hurt = hurt[: len(hurt) // 2] + rng.randbytes(50) + hurt[len(hurt) // 2 :]
    data = b"".join([*p[:bad], bytes(hurt), *p[bad + 1 :]])
    found = salvage(data)
    assert set(range(9)) - {bad} <= set(ids(found)) <= set(range(9))
    assert any(f[2] for f in found)
    check_cover(found, len(data))


def test_wrong_length_does_not_swallow_the_next():
    p = parts(4, False)
    p[1] = p[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    found = salvage(b"".join(p))
    assert ids(found) == [0, 2, 3]
    # A length that reaches exactly to a later record's end is caught by the digest.
    q = parts(3, False)
    head = q[0].index(b"\r\n\r\n") + 4
    length = len(q[0]) - head - 4
    longer = str(len(q[0]) + len(q[1]) - head - 4).encode()
    at = q[0].rindex(b"Content-Length: ", 0, head)
    q[0] = q[0][:at] + b"Content-Length: " + longer + q[0][at + 16 + len(str(length)) :]
    assert set(ids(salvage(b"".join(q)))) >= {2}


def test_record_longer_than_a_chunk():
    p = b"x" * (3 * warc.CHUNK)
    big = warc.record(7, None, p, hashlib.sha256(p).hexdigest(), None)
    for data in (big + raw_record(8), gzip.compress(big) + gzip.compress(raw_record(8))):
        assert ids(salvage(data)) == [7, 8]


def test_round_trip(spark):
    same = "<html>" + "same " * 40
    rows = [(i, f"http://h/{i}\r\n", same if i % 3 == 0 else f"<p>{i}</p>" * i, "a", i) for i in range(60)]
    rows += [(100, None, None, "a", 1), (101, "", "", "a", 1), (102, "ü b", "short", "a", 1), (103, "u", "short", "a", 1)]
    rows += [(None, "n", same, "a", 1), (200, "t", "twice" * 30, "a", 1), (200, "t", "twice" * 30, "a", 1)]
    files = warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), scratch_dir(spark, "warc-test"))
    assert files.selectExpr("sum(records)").first()[0] == len(rows)
    got = warc.read_warc(files).collect()
    assert all(r.reason is None for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.record_id, []).append(r)
    assert sum(map(len, by_id.values())) == len(rows)
    for page, _, html, *_ in rows:
        text = (html or "").encode()
        for r in by_id[warc.record_id(page)]:
            assert r.payload_bytes == len(text) and r.payload_digest == hashlib.sha256(text).hexdigest()
            first = 0 if html == same else page
            again = page != first and len(text) >= 100
            assert r.type == ("revisit" if again else "response")
            assert r.refers_to == (warc.record_id(first) if again else None)
            assert bytes(r.payload) == (b"" if again else text)


def test_empty_table_and_empty_file(spark):
    path = scratch_dir(spark, "warc-test")
    files = warc.write_warc(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_warc(files).collect() == []
    create(f"{path}/empty.warc").close()
    assert warc.read_warc(spark.createDataFrame([(f"{path}/empty.warc",)], "file string")).collect() == []


def test_records_of_one_member_survive_a_bad_one():
    p = parts(9, False)
    p[4] = p[4].replace(b"<p>4</p>", b"<p>X</p>", 1)
    one = gzip.compress(b"".join(p))
    data = gzip.compress(raw_record(20)) + one + gzip.compress(raw_record(21))
    found = salvage(data)
    assert ids(found) == [20, 0, 1, 2, 3, 5, 6, 7, 8, 21]
    start = sum(map(len, p[:4]))
    at = len(gzip.compress(raw_record(20)))
    gaps = [f[:3] for f in found if f[2]]
    assert gaps == [(at, len(one), f"warc-block-digest differs; inflated bytes {start} to {start + len(p[4])}")]
    # Garbage instead of the first and the last record.
    p = [b"no record", *parts(5, False)[1:4], b"no WARC/1. record"]
    found = salvage(gzip.compress(b"".join(p)))
    assert ids(found) == [1, 2, 3] and sum(f[2] is not None for f in found) == 2


@pytest.mark.parametrize("level", [0, 6])
def test_records_before_a_break_are_kept(level):
    rng = random.Random(5)
    p = []
    for i in range(40):
        value = rng.randbytes(3000).hex().encode()
        p.append(warc.record(i, None, value, hashlib.sha256(value).hexdigest(), None))
    one, last = gzip.compress(b"".join(p), level), gzip.compress(raw_record(90))
    for data in (one[: len(one) // 2] + last, one[: len(one) // 2], one[: len(one) // 2] + b"\xff" * 40 + one[len(one) // 2 + 40 :] + last, one[:-8] + b"\0" * 8 + last):
        found = salvage(data)
        got = ids(found)
        if data.endswith(last):
            assert got.pop() == 90
        assert len(got) == len(set(got)) and got[:19] == list(range(19))
        assert any(f[2] for f in found)
        check_cover(found, len(data))
    assert got == list(range(40))


def test_long_members_are_inflated_in_pieces():
    rng = random.Random(6)
    value = rng.randbytes(1 << 19) + bytes(1 << 19)
    p = [warc.record(i, None, value, hashlib.sha256(value).hexdigest(), None) for i in range(12)]
    p[3] = p[3][:-900] + b"?" + p[3][-899:]
    one = gzip.compress(b"".join(p))
    found = salvage(one + gzip.compress(raw_record(20)))
    assert ids(found) == [0, 1, 2, *range(4, 12), 20]
    assert {f[:2] for f in found} == {(0, len(one)), (len(one), len(gzip.compress(raw_record(20))))}
