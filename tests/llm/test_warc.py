import gzip
import hashlib

import pytest

from convolytics.llm import warc
from convolytics.llm.common import scratch_path
from convolytics.llm.queries import QUERIES
from tests_paths import SF001

BIG = "<html>" + "é" * 700 + "</html>"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (3, "http://a/3", BIG), (None, "http://a/n", BIG),
    (4, "http://a/4\r\nX: y", "small"), (5, "http://a/5", "small"), (6, "u", None), (7, "u", ""),
    (8, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n" * 40), (9, "u", "x" * 300_000),
]
SCHEMA = "page_id long, url string, html string"


def expected(pages, least=1000):
    out = []
    for p, _, h in pages:
        raw = (h or "").encode()
        same = [q for q, _, g in pages if (g or "") == (h or "") and q is not None]
        latest = max(same, default=None)
        copy = len(raw) >= least and latest is not None and p != latest
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if copy else "response", latest if copy else None))
    return sorted(out, key=str)


def test_round_trip_of_edge_cases(spark):
    frame = spark.createDataFrame([(*p, "clash") for p in PAGES], SCHEMA + ", digest string")
    got = warc.archive_round_trip(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(PAGES)


def test_whole_table(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op7_warc"](spark, SF001).collect()), key=str) == expected(pages)


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_payloads_and_urls_come_back_and_gunzip_reads_the_files(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.plan_records(spark.createDataFrame(PAGES, SCHEMA)), path, records_per_file=3)
    rows = warc.read_archives(spark, path).collect()
    assert {r.kind for r in rows} == {"record"} and len(rows) == len(PAGES)
    big = [r for r in rows if r.fields["warc-record-id"] == "<urn:page:9>"]
    assert big[0].payload == b"x" * 300_000 and big[0].fields["warc-target-uri"] == "u"
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        assert gzip.decompress(bytes(r.content)).startswith(b"WARC/1.1")


def members():
    return [warc._member(i, "u", b"body %d" % i * 50, hashlib.sha1(b"body %d" % i * 50).hexdigest(), None, "2020-01-01T00:00:00Z") for i in range(4)]


def names(data):
    return [(k, f["warc-record-id"] if f else None) for k, _, _, _, f, _ in warc.salvage(data)]


def pages(*ids):
    return [("record", f"<urn:page:{i}>") for i in ids]


def test_salvage_of_clean_files():
    m = members()
    assert names(b"".join(m)) == pages(0, 1, 2, 3)
    assert names(b"".join(map(gzip.decompress, m))) == pages(0, 1, 2, 3)  # plain records
    assert names(gzip.compress(b"".join(map(gzip.decompress, m)))) == pages(0, 1, 2, 3)  # one member
    assert names(b"") == [] and names(b"\r\n\r\n") == []


@pytest.mark.parametrize("plain", [False, True])
def test_salvage_recovers_after_damage(plain):
    m = [gzip.decompress(x) for x in members()] if plain else members()
    broken = bytearray(m[1])
    broken[len(broken) // 2] ^= 0xFF
    data = m[0] + bytes(broken) + m[2] + b"garbage" + m[3]
    got = list(warc.salvage(data))
    assert [(k, f["warc-record-id"] if f else None) for k, _, _, _, f, _ in got] == [
        *pages(0), ("gap", None), *pages(2), ("gap", None), *pages(3)
    ]
    gaps = [(o, n, why) for k, o, n, why, _, _ in got if k == "gap"]
    assert gaps[0][:2] == (len(m[0]), len(broken)) and gaps[0][2]
    assert gaps[1][:2] == (len(m[0]) + len(broken) + len(m[2]), 7)


def test_salvage_of_a_truncated_file_and_of_noise():
    m = members()
    assert names(m[0] + m[1][: len(m[1]) // 2]) == [*pages(0), ("gap", None)]
    assert names(b"\x00\xff" * 500) == [("gap", None)]


def test_a_record_whose_digest_holds_is_kept():
    m = members()
    crc = bytearray(m[1])
    crc[-6] ^= 0xFF  # of the member's check sum
    got = list(warc.salvage(m[0] + bytes(crc) + m[2]))
    assert [(k, f["warc-record-id"] if f else None) for k, _, _, _, f, _ in got] == [*pages(0), ("gap", None), *pages(1, 2)]
    # without a digest to check nothing vouches for it
    bare = gzip.decompress(m[1])
    bare = b"\r\n".join(line for line in bare.split(b"\r\n") if b"-Digest" not in line)
    crc = bytearray(gzip.compress(bare, mtime=0))
    crc[-6] ^= 0xFF
    assert names(m[0] + bytes(crc) + m[2]) == [*pages(0), ("gap", None), *pages(2)]


def test_a_wrong_length_hides_no_later_record():
    plain = [gzip.decompress(x) for x in members()]
    head, _, rest = plain[1].partition(b"Content-Length: ")
    wrong = head + b"Content-Length: 9999999" + rest[rest.index(b"\r\n") :]
    assert names(plain[0] + wrong + plain[2])[-1:] == pages(2)


def test_damaged_archives_are_read_by_spark(spark, tmp_dir):
    m = members()
    with open(f"{tmp_dir}/one.warc.gz", "wb") as f:
        f.write(m[0] + b"??" + m[1])
    with open(f"{tmp_dir}/two.warc", "wb") as f:
        f.write(gzip.decompress(m[2]))
    rows = warc.read_archives(spark, tmp_dir).collect()
    assert sorted(r.kind for r in rows) == ["gap", "record", "record", "record"]
    assert sorted(r.page_id for r in warc.page_digests(warc.read_archives(spark, tmp_dir)).collect()) == [0, 1, 2]


def test_one_bad_record_in_a_member_of_several():
    plain = [gzip.decompress(m) for m in members()]
    bad = plain[1].replace(b"body 1", b"BODY 1", 1)
    data = gzip.compress(plain[0] + bad + b"\r\n" + plain[2] + b"\r\n\r\n" + plain[3], mtime=0) + members()[1]
    got = list(warc.salvage(data))
    assert [(k, f["warc-record-id"] if f else None) for k, _, _, _, f, _ in got] == [
        ("record", "<urn:page:0>"), ("gap", None), ("record", "<urn:page:2>"), ("record", "<urn:page:3>"), ("record", "<urn:page:1>")]
    assert got[1][3].startswith("digest does not match") and f"bytes {len(plain[0])} to" in got[1][3]
    assert got[-1][1] + got[-1][2] == len(data)


def test_broken_members_give_the_records_before_the_break():
    noise = hashlib.sha512(b"x").digest() * 9
    body = b"".join(hashlib.sha1(b"%d" % i).digest() for i in range(3000))
    record = gzip.decompress(warc._member(9, "u", body, hashlib.sha1(body).hexdigest(), None, "d"))
    whole = gzip.compress(b"".join(gzip.decompress(m) for m in members()) + record, mtime=0)
    for data in (whole[:-30_000], whole[:-30_000] + noise, whole[:-30_000] + members()[0]):
        got = list(warc.salvage(data))
        ids = [f["warc-record-id"] for k, _, _, _, f, _ in got if k == "record"]
        assert ids[:4] == [f"<urn:page:{i}>" for i in range(4)] and got[0][0] == "gap"
        assert len(ids) == (5 if data.endswith(members()[0]) else 4)
