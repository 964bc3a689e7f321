import gzip
import hashlib
from collections import Counter

import pytest

from revlake.llm import warc as W

PAGES = [
    (1, "http://a/é x", "p" * 100), (2, None, "p" * 100), (3, "u", "q" * 99), (4, "u", "q" * 99), (5, "u", None), (6, "u", ""),
    (1, "http://a/é x", "p" * 100), (None, "u", "p" * 100), (None, None, "é" * 300), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "u\r\nX: y", "z" * 200_000),
]
SCHEMA = "page_id long, url string, html string, digest string, payload string, revisit int"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y", 3) for p in PAGES], SCHEMA)


def test_round_trip(spark, pages):
    want = Counter()
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        first = min(same) if len(body) >= 100 and same else i
        want[i, len(body), hashlib.sha256(body).hexdigest(), "response" if first == i else "revisit", None if first == i else first] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.archived_pages(pages).collect())
    assert got == want
    assert W.archived_pages(pages.limit(0)).count() == 0


def test_files_are_ordinary_archives(spark, pages, tmp_path):
    W.write_archives(pages, str(tmp_path / "w"), records_per_file=3)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part")]
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert len(files) >= 4 and text.count(b"WARC-Record-ID") == len(PAGES)
    rows = W.read_archives(spark, str(tmp_path / "w")).collect()
    assert all(r.gap is None for r in rows) and {len(r.payload) for r in rows if r.record_id == "<urn:page:8>"} == {200_000}


def records(n, packed=True):
    made = [W.record(i, "u", b"payload %d " % i * 30) for i in range(n)]
    return [W.member(m) for m in made] if packed else made


def found(data):
    return [(f.get("warc-record-id"), b, e) if not why else (why, b, e) for b, e, why, f, _ in W.salvaged(data)]


@pytest.mark.parametrize("packed", [True, False])
def test_records_behind_damage_are_recovered(packed):
    parts = records(6, packed)
    at = [sum(map(len, parts[:i])) for i in range(7)]
    whole = b"".join(parts)
    assert [x[0] for x in found(whole)] == [f"<urn:page:{i}>" for i in range(6)]
    for k, where in ((0, 1), (2, len(parts[2]) // 2), (5, len(parts[5]) - 6)):
        broken = bytearray(whole)
        broken[at[k] + where] ^= 0x55
        got = found(bytes(broken))
        assert [x[0] for x in got if x[0].startswith("<")] == [f"<urn:page:{i}>" for i in range(6) if i != k]
        assert [(b, e) for x, b, e in got if not x.startswith("<")] == [(at[k], at[k + 1])]
    cut = found(whole[: at[4] + 20])
    assert [x[0] for x in cut[:4]] == [f"<urn:page:{i}>" for i in range(4)] and cut[4][1:] == (at[4], at[4] + 20)
    noise = b"\x1f\x8b\x08junk WARC/1.0 more"
    got = found(noise + whole[: at[2]] + noise + whole[at[2] :] + noise)
    assert [x[0] for x in got if x[0].startswith("<")] == [f"<urn:page:{i}>" for i in range(6)]
    assert [e - b for x, b, e in got if not x.startswith("<")] == [len(noise)] * 3
    assert found(b"") == []


def test_damaged_files_through_spark(spark, tmp_path):
    parts = records(3)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2])
    (tmp_path / "b.warc").write_bytes(b"".join(records(2, packed=False)))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    rows = W.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows if r.gap is None) == ["<urn:page:0>"] * 2 + ["<urn:page:1>", "<urn:page:2>"]
    (gap,) = [r for r in rows if r.gap is not None]
    assert (gap.begin, gap.end, gap.gap) == (len(parts[0]), len(parts[0]) + len(parts[1]) - 9, "damaged member")


def ids(data):
    return [x if not x.startswith("<") else int(x[10:-1]) for x, _, _ in found(data)]


@pytest.mark.parametrize("level", [0, 6])
def test_records_of_one_member_around_a_damaged_one(level):
    parts = records(9, packed=False)
    for gone in ([0], [4], [8], [2, 3], [2, 6]):
        broken = [p[:-20] + b"#" + p[-19:] if i in gone else p for i, p in enumerate(parts)]
        whole = W.member(b"".join(broken), level)
        got = found(whole)
        assert [x for x in ids(whole) if isinstance(x, int)] == [i for i in range(9) if i not in gone]
        assert [x for x, _, _ in got if not x.startswith("<")] == ["damaged record in a member"] * len({i - n for n, i in enumerate(gone)})
        assert {(b, e) for _, b, e in got} == {(0, len(whole))}


def noisy(n):
    import random

    r = random.Random(3)
    return [W.record(i, "u", r.randbytes(3000)) for i in range(n)]


@pytest.mark.parametrize("level", [0, 6])
def test_records_of_one_member_before_damage_or_a_cut(level):
    parts, other = noisy(60), records(2)
    pack, ends, whole = W.zlib.compressobj(level, W.zlib.DEFLATED, 31), [], b""
    for p in parts:
        whole += pack.compress(p) + pack.flush(W.zlib.Z_FULL_FLUSH)
        ends.append(len(whole))
    whole += pack.flush()
    plain = W.member(b"".join(parts), level)
    for k in (1, 30, 59):
        cut = whole[: ends[k] - 100]
        assert ids(cut) == [*range(k), "damaged member"]
        broken = bytearray(whole)
        broken[ends[k - 1]] |= 0x06  # no such kind of block
        got = found(bytes(broken) + b"".join(other))
        assert [x for x in ids(bytes(broken) + b"".join(other)) if isinstance(x, int)][: k] == list(range(k))
        assert [x for x, _, _ in got][-2:] == ["<urn:page:0>", "<urn:page:1>"] and "damaged member" in {x for x, _, _ in got}
        places = sorted({(b, e) for _, b, e in got})
        assert places[0][0] == 0 and all(a[1] == b[0] for a, b in zip(places, places[1:])) and places[-1][1] == len(broken) + len(b"".join(other))
        short = plain[: len(plain) * k // 61]
        numbers = [x for x in ids(short) if isinstance(x, int)]
        assert numbers == list(range(len(numbers))) and k - 1 <= len(numbers) <= k
    for many in (whole, plain):
        checksum = bytearray(many)
        checksum[-6] ^= 0x55
        assert ids(bytes(checksum)) == [*range(60), "damaged member"]
    swapped = parts[:20] + [parts[20][:-20] + b"#" + parts[20][-19:]] + parts[21:]
    both = W.member(b"".join(swapped), level)
    got = ids(both[: len(both) // 2])
    assert got[:21] == [*range(20), "damaged record in a member"] and got[21:-1] == list(range(21, 20 + len(got) - 21)) and got[-1] == "damaged member"


def test_members_of_many_records_through_spark(spark, tmp_path):
    parts = records(5, packed=False)
    parts[2] = parts[2].replace(b"payload 2", b"payload 3", 1)
    whole = W.member(b"".join(parts))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    rows = W.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in rows if r.gap is None) == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
    assert [(r.gap, r.begin, r.end) for r in rows if r.gap is not None] == [("damaged record in a member", 0, len(whole))]
