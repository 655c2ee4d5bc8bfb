import gzip
import hashlib
import io
import random

from rostrum.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def pages():
    rng = random.Random(9)
    shared = ["<p>" + "ä" * 700 + "</p>", "x" * 1000, "y" * 999]
    rows = [(1, None, None), (2, "http://a/ b\r\nX: y", ""), (3, "u", "<p>\x1f\x8b\x08 not a record WARC/1.1</p>"), (4, "big", "".join(rng.choice("abc<>") for _ in range(3_000_000)))]
    rows += [(10 + i, f"http://h/{i}", rng.choice(shared)) for i in range(60)]
    rows += [(200 + i, f"http://h/{i}", "".join(rng.choice("ab ") for _ in range(rng.randrange(3_000)))) for i in range(100)]
    return [(*r, "own") for r in rows]


def test_round_trip_in_splits_of_any_size(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write(warc.planned(df), folder, archive_bytes=20_000)
    assert manifest.count() > 3
    top = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            top[data] = max(i, top.get(data, i))
    for split in (1_777, 50_000, 1 << 30):
        got = {r.page: r for r in warc.read(manifest, folder, split, with_payload=True).withColumn("page", warc.page_of("record_id")).collect()}
        assert set(got) == {r[0] for r in rows}
        for i, _, html, _ in rows:
            r, data = got[i], (html or "").encode()
            first = top.get(data, i)
            assert r.intact and r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
            assert r.record_type == ("response" if first == i else "revisit")
            assert r.refers_to == (None if first == i else f"{warc.URN}{first}")
            assert r.payload == (data if first == i else None)


def test_false_magic_and_damaged_members_are_passed_over():
    good = [gzip.compress(warc._record(i, "u", b"p%d" % i, 2, "00" * 20, "response", None)) for i in range(3)]
    other = gzip.compress(b"no record")
    data = b"junk\x1f\x8b\x08\x00" + good[0] + other + good[1][:-6] + good[2] + b"\x1f\x8b"
    source = warc._Source(File(data))
    assert [warc.parse(c)["warc-record-id"][-2] for _, c in warc.records_in(source, 0, len(data))] == ["0", "2"]
    cut = data.index(good[2])
    assert [o for o, _ in warc.records_in(source, 0, cut)] == [8] and [o for o, _ in warc.records_in(source, cut, len(data))] == [cut]


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    text = "z" * 2_000
    rows = [(5, "u", text, ""), (5, "u", text, ""), (None, "u", text, ""), (3, "u", text, "")]
    folder = f"file://{tmp_path}/a"
    got = warc.read(warc.write(warc.planned(spark.createDataFrame(rows, SCHEMA)), folder), folder).withColumn("page", warc.page_of("record_id")).collect()
    assert sorted(((r.page or 0), r.record_type) for r in got) == [(0, "revisit"), (3, "revisit"), (5, "response"), (5, "response")]


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert warc.read(warc.write(warc.planned(spark.createDataFrame([], SCHEMA)), folder), folder).count() == 0
