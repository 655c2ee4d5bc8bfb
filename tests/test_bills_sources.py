import collections
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum import schemas
from rostrum.functions import bills as b
from rostrum.functions import dates
from rostrum.operators import dictionaries
from rostrum.sources import readers, writers
from rostrum.streaming import ingest


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_citations(spark):
    got = one(spark, b.citations(F.lit("On H.R. 5, S.J.Res. 12, H. Con. Res. 3 and HRES7; not HR"), F.lit(110)))
    assert [(r.bill_type, r.bill_number) for r in got] == [("hr", 5), ("sjres", 12), ("hres", 7)]
    got = one(spark, b.bill_from_url(F.lit("https://x/v3/bill/117/HR/3684?format=json")))
    assert (got.congress, got.bill_type, got.bill_number) == (117, "hr", 3684)
    assert one(spark, b.bill_from_url(F.lit("nothing"))) is None


def test_page_counts(spark):
    for text, want in {"iv+120 p.": 124, "5-9": 5, "xix+1,200 p., 10-20": 1230, "12345 p.": 12345, "1,234,567 p.": 1234567, "none": 0}.items():
        assert one(spark, b.page_count(F.lit(text))) == want


def test_ids_and_roles(spark):
    assert one(spark, b.id_label(F.lit("hres12-105"))) == "105 H.Res. 12"
    r = one(spark, b.role_and_affiliation(F.lit("Director, Agency of X, p. 12")))
    assert (r.role, r.affiliation) == ("Director", "Agency of X")
    assert one(spark, dates.session_start(F.lit(115))).isoformat() == "2017-01-03"
    assert one(spark, dates.election_congress(F.lit(2016))) == 115


def test_moderation_without_cosponsors(spark):
    zero = F.lit(0)
    assert one(spark, b.moderation(F.lit("Democrat"), zero, zero, zero)) == 0.0
    assert one(spark, b.extremism(zero, zero, zero)) is None


def test_narrow_types(spark):
    df = spark.createDataFrame([("115", "x", "2017-01-02", "1"), ("bad", "y", "n/a", "7")], "congress string, target_sentence string, hearing_date string, dem string")
    out = schemas.narrow(df)
    assert out.schema["congress"].dataType == T.ShortType() and "text" in out.columns
    assert [r.congress for r in out.collect()] == [115, None] and out.collect()[1].hearing_date is None


def test_readers(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "members.csv").write_text('bioguide_id,party,last_name,first_name,state\nA,R,"O""Neil",Al,TX\n')
    got = readers.table(spark, str(folder), "members").first()
    assert (got.last_name, got.party, got.state) == ("O'Neil".replace("'", '"'), "R", "TX")
    (folder / "texts.csv").write_text('hearing_id,raw_text\nh1,"line one\nline ""two"""\nh2,x\n')
    ids = spark.createDataFrame([("h1",)], "hearing_id string")
    assert [r.raw_text for r in readers.hearing_texts(spark, str(folder / "texts.csv"), ids).collect()] == ['line one\nline "two"']
    (folder / "e.csv").write_text("year,state_po,district,candidatevotes,totalvotes\n2016,WY,0,5,10\n2016,a,b,c,d,e,f\n2018,NY,1,2,4\n")
    assert sorted(r.year for r in readers.elections(spark, str(folder / "e.csv")).collect()) == [2016, 2018]


def test_slices_skip_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("id,v\n2,z\n")
    (tmp_path / "c.csv").write_text("")
    got = readers.slices(spark, f"{tmp_path}/*.csv", T.StructType.fromDDL("id string, v string"), ["id"])
    assert {r.id: r.v for r in got.collect()} == {"1": "x", "2": "z"}


def test_packages(spark, tmp_path):
    page = '{"packages":[{"packageId":"P1","congress":"105","lastModified":"1"},{"packageId":"P1","congress":"106","lastModified":"2"},{"title":"no id"}]}'
    (tmp_path / "p.json").write_text(page)
    assert [(r.packageId, r.congress) for r in readers.packages(spark, str(tmp_path)).collect()] == [("P1", 106)]


def test_term_lists(spark, tmp_path):
    (tmp_path / "dict_1.csv").write_text("Due Process\ndue-process\n")
    (tmp_path / "dict_2.csv").write_text("Liberty\n")
    got = {(r.version, r.term) for r in dictionaries.load_terms(spark, f"{tmp_path}/dict_*.csv").collect()}
    assert got == {(1, "due process"), (2, "liberty")}


def test_term_frequency_whole_words(spark):
    df = spark.createDataFrame([("h", "The due-process clause."), ("h", "process DUE process processes")], "h string, t string")
    got = {r.term: (r.n, r.n_words) for r in dictionaries.term_frequency(df, ["h"], "t", ["due process", "process", "zzz"]).collect()}
    assert got == {"due process": (2, 8), "process": (3, 8), "zzz": (0, 8)}


def test_terms_of_any_number_equal_counting_one_by_one(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "b", "ab", "c", "É", "d-e", "x1"])
    rows = [(rng.choice(["h", "i", None]), " ".join(word() + rng.choice(["", ".", "  "]) for _ in range(rng.randrange(0, 60)))) for _ in range(150)]
    rows += [("h", None), ("h", ""), ("only", "zzz"), ("j", "a " * 40), ("j", "a b " * 30)]
    terms = sorted({" ".join(rng.choice(["a", "b", "ab", "c", "d", "e", "x1"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)} | {"never said", "a a", "a b a"})
    want, words = collections.Counter(), collections.Counter()
    for h, t in rows:
        norm = re.sub(" +", " ", re.sub("[^A-Za-z0-9 ]", "", (t or "").lower().replace("-", " "))).strip()
        words[h] += len(norm.split(" ")) if t is not None else 0
        for x in terms:
            want[h, x] += f" {norm} ".count(f" {x} ")
    df = spark.createDataFrame(rows, "h string, t string").repartition(4)
    for chars in (1 << 20, 300):  # at once, and in several scans
        monkeypatch.setattr(dictionaries, "TRIE_CHARS", chars)
        monkeypatch.setattr(dictionaries, "FILL_ROWS", 50)
        got = dictionaries.term_frequency(df, ["h"], "t", terms).collect()
        assert {(r.h, r.term): r.n for r in got} == dict(want) and {r.h: r.n_words for r in got} == dict(words)
        table = spark.createDataFrame([(x,) for x in [*terms, None, "", "a"]], "term string")
        sparse = dictionaries.term_counts(df, ["h"], "t", table).collect()
        assert {(r.h, r.term): r.n for r in sparse if r.term} == {k: n for k, n in want.items() if n}
    empty = dictionaries.term_frequency(df, ["h"], "t", []).count()
    assert empty == 0 and dictionaries.term_frequency(df.limit(0), ["h"], "t", terms).count() == 0


def test_streams_resume(spark, tmp_path):
    landed, out, ck = (str(tmp_path / p) for p in ("in", "out", "ck"))
    schema = T.StructType.fromDDL("id long, ts timestamp, v string")

    def land(rows):
        spark.createDataFrame(rows, "id long, ts string, v string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(landed)

    run = lambda: ingest.append_new(spark, landed, schema, out, ck, key=["id"], time_col="ts")
    land([(1, "2024-01-01", "a"), (2, "2024-01-05", "a"), (1, "2024-01-02", "b")])
    run()
    land([(2, "2024-01-06", "c"), (3, "2024-02-01", "c")])
    run()
    run()
    assert sorted((r.id, str(r.month)) for r in spark.read.parquet(out).collect()) == [(1, "2024-01"), (2, "2024-01"), (3, "2024-02")]


def test_upserts_newest_wins(spark, tmp_path):
    landed, out, ck = (str(tmp_path / p) for p in ("in", "out", "ck"))
    schema = T.StructType.fromDDL("id long, m string, v string")
    for rows in ([(1, "2", "new"), (2, "1", "x")], [(1, "1", "stale"), (2, "3", "y")]):
        spark.createDataFrame(rows, "id long, m string, v string").write.mode("append").parquet(landed)
        ingest.upsert_log(spark, landed, schema, out, ck, key=["id"], modified="m")
    assert {r.id: r.v for r in ingest.latest(spark, out).collect()} == {1: "new", 2: "y"}


def test_json_and_messages(spark, tmp_path):
    df = spark.createDataFrame([("q", "a")], "q string, a string")
    writers.to_messages(df, str(tmp_path / "m"), "sys", "q", "a")
    line = spark.read.text(str(tmp_path / "m")).first().value
    assert line == '{"messages":[{"role":"system","content":"sys"},{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'

def test_append_keeps_late_keys_and_survives_a_repeat(spark, tmp_path):
    landed, out, ck = (str(tmp_path / x) for x in ("landed", "out", "ck"))
    schema = "id long, ts timestamp, v string"

    def land(rows):
        spark.createDataFrame(rows, "id long, ts string, v string").selectExpr("id", "timestamp(ts) as ts", "v").coalesce(1).write.mode("append").parquet(landed)
        ingest.append_new(spark, landed, schema, out, ck, key=["id"], time_col="ts")

    land([(3, "2024-06-01 00:00:00", "newest"), (3, "2024-06-02 00:00:00", "copy")])
    land([(2, "2020-01-01 00:00:00", "late"), (3, "2024-06-01 00:00:00", "copy")])
    land([(3, "2021-01-01 00:00:00", "copy")])
    land([(1, "1999-12-31 00:00:00", "latest to land"), (2, "2020-01-01 00:00:00", "copy")])
    got = sorted((r.id, r.v, r.month) for r in spark.read.parquet(out).collect())
    assert got == [(1, "latest to land", "1999-12"), (2, "late", "2020-01"), (3, "newest", "2024-06")]


def test_runs_of_batches_cover_each_batch_once():
    for fan in (2, 3, 8):
        made = set()
        for batch in range(200):
            runs = ingest.runs_before(batch, fan)
            assert [x for a, b in runs for x in range(a, b)] == list(range(batch)) and all(r in made for r in runs)
            assert len(runs) < fan * 9
            made.add((batch, batch + 1))
            for run in ingest._completed_by(batch, fan):
                assert all(part in made for part in ingest._parts_of(run, fan))
                made.add(run)


def test_batches_read_only_the_buckets_they_touch(spark, tmp_path):
    landed, out, ck = (str(tmp_path / x) for x in ("landed", "out", "ck"))
    schema = "id long, ts timestamp, v string"
    rng = random.Random(3)
    seen, want = set(), {}
    for k in range(6):
        rows = [(rng.choice([None, *range(25)]), f"20{10 + k}-01-0{rng.randrange(1, 9)} 00:00:00", f"{k}-{i:02d}") for i in range(8)]
        spark.createDataFrame(rows, "id long, ts string, v string").selectExpr("id", "timestamp(ts) as ts", "v").coalesce(1).write.mode("append").parquet(landed)
        ingest.append_new(spark, landed, schema, out, ck, key=["id"], time_col="ts", buckets=4, fan=2)
        for i, ts, v in sorted(rows, key=lambda r: (r[1], r[2])):
            if i is None or i not in seen:  # a null is no key and equals no other
                want.setdefault((i, k) if i is None else i, (i, v))
        seen |= {r[0] for r in rows}
    got = sorted(((r.id, r.v) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted(want.values(), key=str)
    runs = {p.name for p in (tmp_path / "out-keys").iterdir()}
    assert {"run=0-2", "run=0-4", "run=4-6", "run=5-6"} <= runs
    keys = spark.read.parquet(f"{out}-keys/run=0-4")
    assert keys.filter("id is not null").count() == keys.filter("id is not null").distinct().count() and set(keys.columns) == {"id", "bucket"}


def test_log_is_put_together(spark, tmp_path):
    landed, out, ck = (str(tmp_path / x) for x in ("landed", "out", "ck"))
    schema = "id long, m long, v string"
    rng = random.Random(4)
    best = {}
    for k in range(5):
        rows = [(rng.randrange(6), rng.randrange(10), f"{k}{i}") for i in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        ingest.upsert_log(spark, landed, schema, out, ck, key=["id"], modified="m", fan=2)
        for i, m, v in rows:
            best[i] = max(best.get(i, (-1,)), (m, k, v))
        got = ingest.latest(spark, out)
        assert got.columns == ["id", "m", "v"] and {r.id: (r.m, r.v) for r in got.collect()} == {i: (m, v) for i, (m, _, v) in best.items()}
        assert got.count() == len(best)
    assert {"run=0-4", "run=4-5", "whole=5"} <= {p.name for p in (tmp_path / "out").iterdir()}
