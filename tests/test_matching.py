import random

import pytest

from rostrum.operators import matching
from rostrum.operators import relational as rel


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[-1]))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("cutoff", [60.0, 75.0, 85.0, 92.0])
def test_similar_pairs_equals_brute_force(spark, cutoff):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("ABCDE ") for _ in range(rnd.randint(1, 14))) for _ in range(60)]

    def vary(s):
        s = list(s)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randint(0, len(s))
            if rnd.random() < 0.5 and s:
                s.pop(min(i, len(s) - 1))
            else:
                s.insert(i, rnd.choice("ABCDE"))
        return "".join(s)

    left = [(i % 2, vary(b)) for i, b in enumerate(base * 2)]
    right = [(i % 2, b) for i, b in enumerate(base)]
    want = {
        (g, a, b)
        for g, a in left
        for h, b in right
        if g == h and a and b and 200 * lcs(a, b) / (len(a) + len(b)) >= cutoff
    }
    l = spark.createDataFrame(left, "g int, a string")
    r = spark.createDataFrame(right, "g int, b string")
    rows = matching.similar_pairs(l, r, ["g"], "a", "b", cutoff).collect()
    assert {(x.g, x.a, x.b) for x in rows} == want and len(rows) == len(want)
    assert all(abs(x.score - 200 * lcs(x.a, x.b) / (len(x.a) + len(x.b))) < 1e-9 for x in rows)


@pytest.mark.parametrize("cutoff", [70.0, 85.0])
def test_similar_long_titles_equal_brute_force(spark, cutoff):
    rnd = random.Random(5)
    words = ["COMMITTEE", "ON", "THE", "BUDGET", "OF", "AND", "HEALTH", "AIR", "TRADE", "ENERGY", "AAAA"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 9))) for _ in range(40)]

    def vary(s):
        s = list(s)
        for _ in range(rnd.randint(0, len(s) // 4)):
            i = rnd.randrange(len(s))
            s[i : i + rnd.randint(0, 1)] = rnd.choice("ABCDE ")
        return "".join(s)

    left = [vary(x) for x in base * 2]
    want = {(x, y) for x in left for y in base if x and 200 * lcs(x, y) / (len(x) + len(y)) >= cutoff}
    l = spark.createDataFrame([(x,) for x in left], "a string")
    r = spark.createDataFrame([(x,) for x in base], "b string")
    rows = matching.similar_pairs(l, r, [], "a", "b", cutoff).collect()
    assert {(x.a, x.b) for x in rows} == want and len(rows) == len(want) > 40


M = "bioguide_id string, congress int, last_name_upper string, last_name string, first_name string, party string, state string"


def member(bio, congress, name, first="X"):
    return (bio, congress, name, name.title(), first, "P", "S")


def test_unambiguous(spark):
    look = spark.createDataFrame([member("S1", 115, "SMITH"), member("S2", 115, "SMITH"), member("J1", 115, "JONES")], M)
    assert [r.last_name_upper for r in matching.unambiguous(look, "congress").collect()] == ["JONES"]


def test_cascade(spark):
    look = spark.createDataFrame(
        [
            member("A1", 115, "SMITH", "Ann"), member("A2", 115, "SMITH", "Bob"), member("D3", 116, "DOE"),
            member("C1", 116, "CRUZ"), member("K1", 116, "KOWALSKI"), member("H1", 116, "HALL"),
        ],
        M,
    )
    hmap = spark.createDataFrame([("H1", *member("Z9", 115, "ZED"))], "hearing_id string, " + M).drop("congress")
    leaders = spark.createDataFrame(
        [(116, "HSGO", "chair", 0, "H1"), (116, "HSGO", "chair", 1, "C1")], "congress int, thomas_id string, role string, ord int, bioguide_id string"
    )
    members = look.select("bioguide_id", "last_name", "first_name", "party", "state").distinct()
    pairs = spark.createDataFrame(
        [
            ("H1", "ZED", "ZED", 115, None), ("H1", "BOB SMITH", "SMITH", 115, None), ("H1", "SMITH", "SMITH", 115, None),
            ("H2", "DOE", "DOE", 116, "hsgo00"), ("H2", "DE LA CRUZ", "CRUZ", 116, "hsgo00"), ("H2", "CHAIRMAN", "CHAIRMAN", 116, "hsgo00"),
            ("H2", "KOWALSKY", "KOWALSKY", 116, "hsgo00"), ("H2", "NOBODY", "NOBODY", 116, "hsgo00"), ("H2", None, None, 116, None),
        ],
        "hearing_id string, speaker_last_name string, speaker_last_word string, congress int, committee_code string",
    )
    rows = matching.match_pairs(pairs, hmap, look, leaders, members).collect()
    assert len(rows) == 9
    got = {r.speaker_last_name: (r.bioguide_id, r.match_type) for r in rows}
    assert got == {
        "ZED": ("Z9", "hearing_member_exact"), "BOB SMITH": ("A2", "exact_disambiguated"), "SMITH": (None, None),
        "DOE": ("D3", "congress_exact"), "DE LA CRUZ": ("C1", "congress_exact"), "CHAIRMAN": ("H1", "committee_chair_exact"),
        "KOWALSKY": ("K1", "fuzzy"), "NOBODY": (None, None), None: (None, None),
    }


def test_fuzzy_winner_must_be_one_member(spark):
    look = spark.createDataFrame([member("A1", 1, "KOWALSKI"), member("A2", 1, "KOWALSKI")], M)
    names = spark.createDataFrame([("KOWALSKY", "KOWALSKY", 1)], "speaker_last_name string, speaker_last_word string, congress int")
    assert matching.similar_names(names, look).count() == 0


def test_validated_lookup_refuses_duplicates(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        rel.lookup_join(left, right, ["k"], validate=True).collect()


def test_write_back_matches_null_committee(spark):
    a = spark.createDataFrame([("h", "X", None), ("h", None, None)], "h string, n string, c string")
    b = spark.createDataFrame([("h", "X", None, 1), ("h", None, None, 2)], "h string, n string, c string, v int")
    got = {r.n: r.v for r in rel.null_safe_join(a, b, ["h", "n"], ["c"]).collect()}
    assert got == {"X": 1, None: None}


def test_late_witnesses_and_outsiders(spark):
    df = spark.createDataFrame(
        [("DOE", "DOE", None, None, None), ("CHAIRMAN", "CHAIRMAN", None, None, None), ("A B", "B", None, None, None), ("X", "X", "H1", 0.5, None), ("Y", "Y", "S9", None, None)],
        "speaker_last_name string, speaker_last_word string, bioguide_id string, nominate_dim1 double, seniority int",
    )
    left = matching.without_outsiders(matching.without_late_witnesses(df))
    assert sorted(r.speaker_last_name for r in left.collect()) == ["A B", "CHAIRMAN", "X"]
