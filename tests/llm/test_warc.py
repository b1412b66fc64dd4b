"""WARC archives: what is read back, plain grouping, and what the files hold."""

import hashlib
import io
import random
import struct
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from quillspark.llm import warc


def pages():
    rng = random.Random(13)
    out = [(i, f"https://host/{i}", f"<html><body>page {i} " + " ".join(rng.choice(["lorem", "ipsum", "é", "日本"]) for _ in range(rng.randint(0, 80))) + "</body></html>") for i in range(300)]
    same, small = "<p>" + "one page " * 30, "<p>small</p>"
    out += [(i, None, same) for i in range(300, 420)] + [(i, "u", small) for i in range(420, 440)]
    out += [(440, "u", None), (441, "u", ""), (442, "https://a/b\r\nWARC-Type: x y", "x" * 99), (443, "u", "x" * 99), (444, "u", "y" * 100), (445, "u", "y" * 100)]
    out += [(446, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), (447, "u", "z" * 3_000_000), (448, "u", "z" * 3_000_000), (449, "u", "".join(rng.choice("abcdef\n") for _ in range(1_500_000)))]
    out += [(None, "u", same), (450, "u", "n" * 200), (None, "u", "n" * 200), (None, "u", "m" * 200), (None, "u", "m" * 200), (300, "v", same), (7, "again", out[7][2] + "!")]
    return out


def plainly(rows):
    first = defaultdict(list)
    for i, _, html in rows:
        if i is not None:
            first[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        least = min(first[html or ""], default=None)
        again = len(data) >= 100 and least is not None and i != least
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, u, h, "d", 1, "x") for i, u, h in pages()], "page_id long, url string, html string, digest string, copies int, payload string").repartition(3)


def test_round_trip_equals_grouping(spark, table):
    assert sorted(map(tuple, warc.round_trip(table).collect()), key=str) == plainly(pages())


def test_payloads_come_back(spark, table, tmp_path):
    index = warc.write(table, f"file://{tmp_path}/a")
    got = warc.read(warc.archives(spark, f"{tmp_path}/a")).collect()
    assert all(r.intact for r in got) and len(got) == len(pages()) == index.count()
    referring = Counter((r[0], r[2]) for r in plainly(pages()) if r[3] == "revisit")
    whole = Counter((i, (h or "").encode()) for i, _, h in pages())
    for (i, digest), n in referring.items():
        whole -= Counter({next(x for x in whole if x[0] == i and hashlib.sha256(x[1]).hexdigest() == digest): n})
    assert Counter((r.page_id, bytes(r.payload)) for r in got if r.record_type == "response") == whole
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.url for r in got if r.page_id == 442} == {"https://a/b%0D%0AWARC-Type:%20x%20y"}
    assert {r.url for r in got if r.page_id == 301} == {None}


def test_files_hold_a_dictionary_and_a_frame_a_record(spark, table, tmp_path):
    rows = warc.write(table, f"file://{tmp_path}").collect()
    files = sorted(tmp_path.glob("*"))
    assert {f.name for f in files} == {Path(r.archive).name for r in rows}  # nothing else is left
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_FRAME
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        mine = sorted((r for r in rows if Path(r.archive).name == f.name), key=lambda r: r.offset)
        assert mine[0].offset == 8 + size and sum(r.length for r in mine) == len(data) - 8 - size
        for r in mine[:40]:
            frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[r.offset : r.offset + r.length])
            assert frame.startswith(b"WARC/1.1\r\n") and frame.endswith(b"\r\n\r\n")
            one = warc.record_at(r.archive, r.offset)
            assert one.fields["warc-type"] == r.record_type
            assert r.page_id is None or one.fields["warc-record-id"] == f"<urn:page:{r.page_id}>"


def test_dictionary_pays(spark):
    records = [warc.record(warc.Page(i, f"https://host/{i}", b"<html><head><title>page</title></head><body>%d</body></html>" % i, "0" * 64, None))[0] for i in range(2000)]
    known = warc.dictionary(records)
    plain, short = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=3, dict_data=known)
    assert len(known.as_bytes()) <= warc.DICTIONARY_BYTES
    assert sum(len(short.compress(r)) for r in records) < 0.5 * sum(len(plain.compress(r)) for r in records)


def test_archives_are_cut_and_others_are_read(spark, monkeypatch, tmp_path):
    store, path = warc._store(str(tmp_path))
    a = warc.Archive(store, f"{path}/x.warc.zst", "x")
    for i in range(3):
        a.add(warc.Page(i, "u", b"p" * i, hashlib.sha256(b"p" * i).hexdigest(), None))
    a.close()
    raw = warc.opened((tmp_path / "x.warc.zst").open("rb")).read()
    packed = zstandard.ZstdCompressor().compress
    (tmp_path / "plain.warc.zst").write_bytes(packed(raw))  # no dictionary
    trained = warc.dictionary([raw[i : i + 200] for i in range(0, 400, 2)] * 5).as_bytes()
    inner = packed(trained)  # a dictionary that is compressed itself
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained)).compress(raw)
    (tmp_path / "inner.warc.zst").write_bytes(struct.pack("<II", warc.DICTIONARY_FRAME, len(inner)) + inner + frame)
    got = warc.read(warc.archives(spark, str(tmp_path))).collect()
    assert Counter((r.page_id, r.payload, r.intact) for r in got) == Counter({(i, b"p" * i, True): 3 for i in range(3)})


def test_many_archives_a_task(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", f"{i} " * 400) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = warc.write(rows, str(tmp_path), archive_bytes=10_000)
    assert index.select("archive").distinct().count() > 3
    assert sorted(r.page_id for r in warc.read(warc.archives(spark, str(tmp_path)), payloads=False).collect()) == list(range(40))


def test_broken_archives_are_told():
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.records(io.BytesIO(b"hello\r\n")))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))
    wrong = b"WARC/1.1\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (r,) = warc.records(io.BytesIO(wrong))
    assert r.payload == b"abc" and r.digest != "00"


def test_published_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "p" * 200)], "page_id long, url string, html string")
    index = warc.write(rows, str(tmp_path))
    before = sorted(tmp_path.rglob("*"))
    warc._publish(index.select("archive").distinct(), str(tmp_path), "none")  # a second attempt finds them moved
    assert sorted(tmp_path.rglob("*")) == before
    assert warc.read(index.select("archive")).select(F.max("page_id")).first()[0] == 1


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
