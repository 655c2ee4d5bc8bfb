import random
import re
from collections import Counter

from rostrum.llm import quality

SCHEMA = "doc_id long, text string, n_chars long, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(8)
    yield from (None, "", "\n\n", "a", "a b " * 3, "one two three four five six seven eight " * 4, "Ä é 😀 \x0b x|y <b> # $$" + "\n" * 3)
    yield " ".join(["w"] * 200_000)
    for _ in range(80):
        words = [rng.choice("abcde") for _ in range(rng.randrange(5, 80))]
        yield "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0c", "|"]) for w in words)


def test_base_metrics_equal_brute_force(spark):
    rows = [(i, t, 1, "own") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows + rows[:3], SCHEMA)).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert not (r.kept and r.base_failed)


def test_lines_go_first_and_then_documents(spark):
    prose = "The committee heard the witness at length, and nobody in the room objected to a single word of it, said one."
    more = "Later that day another member asked whether the figures had been checked."
    rows = [
        (1, f"{prose}\nHome | About | Contact\nLicensed under the Apache License.\n{more}", 0, ""),
        (2, "Home | About | Contact us here | Imprint | Terms | News | Sports\n" * 9 + prose, 0, ""),
        (3, f"{prose}\nWHAT!! A!! DEAL!! BUY!! NOW!! TODAY!!\nthis$$$ one%%% too&&& here***", 0, ""),
        (4, f"{prose} See a | b once in a long line that is otherwise prose, which stays.", 0, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.kept for r in quality.assess(df).collect()} == {1: True, 2: False, 3: True, 4: True}
    clean = {r.doc_id: r for r in quality.clean(df).collect()}
    assert clean[1].text == f"{prose}\n{more}" and clean[1].n_chars == len(clean[1].text)
    assert clean[3].text == prose and clean[4].text == rows[3][1]
    assert quality.clean(df).columns == df.columns


def test_empty_table(spark):
    assert quality.assess(spark.createDataFrame([], SCHEMA)).count() == 0
