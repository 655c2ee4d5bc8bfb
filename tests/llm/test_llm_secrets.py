import hashlib
import random
import re

from pyspark.sql import functions as F

from rostrum.llm import secrets

SCHEMA = "doc_id long, text string, spans string"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def texts():
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    yield from (None, "", " ", "plain words only", "token: password = abcdefghijklmnop", "api_key='0123456789abcdef0123' token=short", "AKIAAKIA12 AKIAABCDEFGHIJKLMN1", "é ñ 😀 secret:ABCDEFGHIJKLMNOP 😀 deadbeefdeadbeef")
    yield " ".join(f"é{rng.randrange(16**18):018x}" for _ in range(700))
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            parts.append(rng.choice(["Token", "PASSWORD", "api_key", "apikey", "x"]) + rng.choice(["=", " : ", '"="', "= '"]) + "".join(rng.choice(b64) for _ in range(rng.choice([5, 12, 30]))))
            parts.append(rng.choice(["AKIA", "akia", "ÀB"]) + "".join(rng.choice("ABZ019") for _ in range(rng.choice([3, 13, 14, 20]))))
            parts.append("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([15, 16, 40]))))
        yield rng.choice([" ", "\n", "😀", ""]).join(parts)


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "own") for i, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = secrets.scan(df).select("text", secrets.spelled(F.col("base_spans")).alias("base"), secrets.spelled(F.col("spans")).alias("all"), F.sha2(secrets.spelled(F.col("base_spans")), 256).alias("sha")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.text)
        assert r.base == want
        assert r.sha == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, r.base.split(","))) <= set(r["all"].split(","))


def test_battery_finds_random_tokens_and_leaves_text(spark):
    rng = random.Random(11)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_ones = ["".join(rng.choice(b64) for _ in range(rng.choice([24, 40, 64]))) for _ in range(200)]
    random_ones = [t for t in random_ones if re.search("[0-9]", t)]
    ordinary = ["enhancementrelease2024candidate", "annual-report-2023-final-version", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "abababababababababababab12", "the_quick_brown_fox_jumps_2_times", "0000000000111111111122222222223x"] * 20
    df = spark.createDataFrame([(i, f"see {t} here", None) for i, t in enumerate(random_ones + ordinary)], SCHEMA)
    hit = {r.doc_id for r in secrets.scan(df).filter("size(spans) > size(base_spans)").collect()}
    n = len(random_ones)
    assert len([i for i in hit if i < n]) >= 0.9 * n
    assert not [i for i in hit if i >= n]


def test_values_behind_a_name_and_in_a_path_are_found(spark):
    rng = random.Random(13)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    known = "wJalrXUtnFEMI/K7MDENG/bPxRfiCY3xQ9LpZ8KEY"
    forms = ("AWS_SECRET_ACCESS_KEY={}", "x?sig={}", "auth={}", "?id=7&sig={}==&v=2", "https://example.com/some-long-page/{}/view", "a_b/{}", "é😀 x={} y")
    rows, value = [], {}
    for form in forms:
        for _ in range(30):
            t = "".join(rng.choice(alnum) for _ in range(40))
            value[len(rows)] = t
            rows.append((len(rows), form.format(t), "own"))
    value[len(rows)] = known
    rows.append((len(rows), f"AWS_SECRET_ACCESS_KEY={known}", "own"))
    plain = ["annual_report_2023_final/version-2-of-the-text", "config_value_number_2=annual_report_2023_final_version", "https://example.com/some-long-page/2024/another-long-page-name"]
    rows += [(len(rows) + i, t, "own") for i, t in enumerate(plain)]
    found = {}
    for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        found[r.doc_id] = [(s.start, s.end) for s in r.spans if s.kind == 3]
    for k in range(len(forms)):
        at = range(30 * k, 30 * k + 30)
        whole = [i for i in at if any(s <= rows[i][1].index(value[i]) and e >= rows[i][1].index(value[i]) + 40 for s, e in found[i])]
        assert len(whole) >= 27, forms[k]
    assert found[30 * len(forms)] == [(22, 22 + len(known))]
    assert not any(found[i] for i in range(30 * len(forms) + 1, len(rows)))
    masked = secrets.redact(spark.createDataFrame([(1, f"AWS_SECRET_ACCESS_KEY={known}\n")], "doc_id long, text string")).first()
    assert masked.text == "AWS_SECRET_ACCESS_KEY=[SECRET]\n"


def test_redact_masks_spans_and_counts_again(spark):
    text = 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" und AKIAABCDEFGHIJKLMN1. Ende'
    df = spark.createDataFrame([(1, text, "a", len(text)), (2, None, "b", 0), (3, "nothing", "c", 7)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert got[1].text == 'é [SECRET]" und [SECRET]. Ende' and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[2].n_chars == 0 and got[3].text == "nothing"
    assert secrets.redact(df).columns == df.columns


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_masking_equals_brute_force_and_grows_with_the_text(spark):
    import random
    import time

    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = []
    for n in (0, 1, 5, 4_095, 4_096, 4_097, 20_000):
        for _ in range(4):
            text = "".join(rng.choice("ab😀é\n") for _ in range(n))
            spans = sorted((lambda a: (a, 0, min(n, a + rng.choice([1, 3, 40, 5_000]))))(rng.randrange(n)) for _ in range(rng.choice([0, 1, 4, 60]))) if n else []
            rows.append((text, spans))
    want = []
    for text, spans in rows:
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out.append(text[at:a])
            at = max(at, b)
        want.append(secrets.MASK.join([*out, text[at:]]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,kind:int,end:int>>")
    assert [r[0] for r in df.select(secrets.masked(F.col("text"), F.col("spans"))).collect()] == want
    assert spark.createDataFrame([([3, 1, 4] * 500,)], "x array<int>").select(secrets._running(F.col("x"))).first()[0] == [sum(([3, 1, 4] * 500)[: i + 1]) for i in range(1_500)]

    def took(n):
        line = "plain words and more of them, then password=Zx81kQ99mmPd, " + "filler " * 20
        docs = spark.createDataFrame([(1, line * n, 0)], "doc_id long, text string, n_chars long")
        t = time.perf_counter()
        r = secrets.redact(docs).first()
        assert r.text.count(secrets.MASK) == n and "Zx81" not in r.text and r.n_chars == len(r.text)
        return time.perf_counter() - t

    took(100)
    assert took(50_000) < 120  # ten megabytes
