import gzip
import hashlib
import random
import zlib

import pytest

from rulesieve.llm import warc
from rulesieve.llm.common import opened
from rulesieve.llm.common import shared_dir
from rulesieve.llm.warc import Gap, Record, member, record, salvage

PAGES = "page_id bigint, url string, html string, digest string, salt int, last bigint"


def _parts(zipped):
    rnd = random.Random(3)
    payloads = [bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 300))) for _ in range(8)] + [b"x WARC/1.1\r\nfoo" * 5, b"\x1f\x8b\x08" * 9]
    own = [record(i, f"http://a/{i}", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)]
    return payloads, [member(x) if zipped else x for x in own]


def test_round_trip():
    for zipped in (False, True):
        payloads, parts = _parts(zipped)
        assert [x.http[1] for x in salvage(b"".join(parts))] == payloads
    assert zlib.decompress(_parts(True)[1][0], 31) == _parts(False)[1][0] == gzip.decompress(_parts(True)[1][0])
    assert list(salvage(b"")) == []


def test_damage_costs_only_what_it_touches():
    rnd = random.Random(5)
    for zipped in (False, True):
        _, parts = _parts(zipped)
        data, ends = b"".join(parts), [0]
        for p in parts:
            ends.append(ends[-1] + len(p))
        for _ in range(150):
            at, n, how = rnd.randrange(len(data)), rnd.choice([1, 5, 400]), rnd.choice(["flip", "cut", "add"])
            noise = bytes(rnd.randrange(256) for _ in range(n))
            bad = {"flip": data[:at] + noise[: len(data) - at] + data[at + n :], "cut": data[:at] + data[at + n :], "add": data[:at] + noise + data[at:]}[how]
            touched = {i for i in range(len(parts)) if ends[i] < (at + 1 if how == "add" else at + n) and ends[i + 1] >= at}
            place, found = 0, set()
            for x in salvage(bad):
                assert x.offset == place
                place += x.length
                if isinstance(x, Record):
                    found.add(warc._number(x.headers["warc-record-id"]))
                else:
                    assert isinstance(x, Gap) and x.reason
            assert place == len(bad)
            assert set(range(len(parts))) - touched <= found


def test_many_records_in_one_archive_take_linear_time():
    one = member(record(1, None, b"p" * 200, hashlib.sha1(b"p" * 200).hexdigest(), None))
    assert sum(isinstance(x, Record) for x in salvage(one * 20_000)) == 20_000


def _expected(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 1000 and same and (page is None or page < max(same))
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_query(spark):
    big, other = "é<p>" * 400, "b" * 1000
    rows = [(1, "http://x/\r\n y", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", other), (7, "u", other), (8, "u", "b" * 999), (10, "u", "b" * 999), (11, "u", "x\r\n\r\nWARC/1.1\r\n" * 100), (12, "u", "é long " * 700_000), (13, "v", "é long " * 700_000)]
    rows = [(*r, "d", 1, 2) for r in rows]
    got = warc.query(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(map(tuple, got), key=str) == _expected(rows)
    assert warc.query(spark.createDataFrame([], PAGES)).collect() == []


def test_gaps_are_logged(spark, tmp_path):
    folder = shared_dir(spark)
    rows = [(i, "u", f"{i}" * 50, "d", 1, 2) for i in range(20)]
    manifest = warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), folder, archive_bytes=10**9)
    path = manifest.first()["path"]
    files, base = opened(f"{folder}/archives")
    with files.open_input_file(f"{base}/{path}") as f:
        data = bytearray(f.read())
    data[len(data) // 2] ^= 255
    with files.open_output_stream(f"{base}/{path}", compression=None) as f:
        f.write(bytes(data))
    got = warc.read(manifest.where(f"path = '{path}'"), folder)
    kept, gaps = got.where("gap IS NULL").count(), got.where("gap IS NOT NULL").collect()
    assert gaps and gaps[0]["length"] > 0 and gaps[-1]["gap"].endswith("of 20") and 0 < kept < manifest.where(f"path = '{path}'").first()["n_records"]


def _numbers(data):
    found = list(salvage(data))
    return [warc._number(x.headers["warc-record-id"]) for x in found if isinstance(x, Record)], [x for x in found if isinstance(x, Gap)]


def test_damage_within_a_member_costs_only_its_record():
    _, plain = _parts(False)
    bad = [*plain[:4], plain[4][:-40] + b"?" + plain[4][-39:], *plain[5:]]
    ids, gaps = _numbers(member(b"".join(bad)) + member(plain[0]))
    assert ids == [0, 1, 2, 3, 5, 6, 7, 8, 9, 0] and len(gaps) == 1 and "digest" in gaps[0].reason
    ids, gaps = _numbers(member(b"junk" + b"".join(plain[:3]) + b"tail"))
    assert ids == [0, 1, 2] and len(gaps) == 2


def test_a_broken_stream_keeps_what_came_before():
    rnd = random.Random(8)
    payloads = [bytes(rnd.randrange(256) for _ in range(3000)) for _ in range(30)]
    plain = [record(i, None, p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)]
    whole, after = member(b"".join(plain)), member(plain[0])
    for at in range(100, len(whole) - 8, 4001):  # cut short, then another member
        ids, gaps = _numbers(whole[:at] + after)
        n = len(ids) - 1
        assert ids == [*range(n), 0] and n >= at // 3400 - 1 and gaps, at
        ids, _ = _numbers(whole[:at])
        assert ids == list(range(n)), at
        ids, gaps = _numbers(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :] + after)
        assert set(range(n)) <= set(ids) and ids[-1] == 0 and gaps, at
    ids, gaps = _numbers(whole[:-6] + b"?" + whole[-5:] + after)
    assert ids == [*range(30), 0] and len(gaps) == 1
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    ids, _ = _numbers((stored.compress(b"".join(plain[:5])) + stored.flush())[:-5])
    assert ids == list(range(5))


def test_a_query_fails_where_a_record_is_lost(spark, monkeypatch):
    whole = warc.write

    def damaged(pages, folder, *rest):
        manifest = whole(pages, folder, *rest)
        files, base = opened(f"{folder}/archives")
        path = manifest.first()["path"]
        with files.open_input_file(f"{base}/{path}") as f:
            data = f.read()
        with files.open_output_stream(f"{base}/{path}", compression=None) as f:  # the last member is gone, what is left is sound
            f.write(data[: data.rfind(b"\x1f\x8b\x08")])
        return manifest

    monkeypatch.setattr(warc, "write", damaged)
    with pytest.raises(Exception, match="gap in .* records of"):
        warc.query(spark.createDataFrame([(i, "u", f"{i}" * 50, "d", 1, 2) for i in range(20)], PAGES)).collect()
