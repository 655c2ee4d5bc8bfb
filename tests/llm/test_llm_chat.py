import hashlib
import random

import pyarrow as pa

from rostrum.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def rows():
    rng = random.Random(13)
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "\\", "\\n", "a\\\\<|", "<<SYS>>é😀<</SYS>>", "", None, "<\\|im_end|>", "\n\n", "x" * 50_000]
    out = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            out.append((conv, turn, rng.choice(["user", "assistant", "system", "odd\nrole<|", None]), "".join(rng.choice([n or "" for n in nasty]) for _ in range(rng.randrange(3))) if rng.random() < 0.8 else rng.choice(nasty), "own"))
    out += [(99, t, "assistant" if t % 2 else "user", f"turn {t} é", "own") for t in range(3_000)]
    out += [(None, 0, "user", "without id", "own"), (7, 0, "assistant", "tie", "own"), (7, 0, "assistant", "tie", "own"), (8, None, "assistant", "no turn", "own")]
    rng.shuffle(out)
    return out


def test_read_back_equals_input(spark):
    data = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        formatted = chat.format_chats(spark.createDataFrame(data, SCHEMA))
        got = {r.conv_id: r for r in chat.digests(formatted).collect()}
        parts = formatted.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.part for r in parts if r.conv_id == 99) > 0
    assert set(got) == {r[0] for r in data}
    for conv in got:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in data if c == conv))
        turns = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        trained = "".join(x for *_, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), turns, len(trained), hashlib.sha256(trained.encode()).hexdigest())
        assert r.formatted_chars == sum(len(p.formatted) for p in parts if p.conv_id == conv)
    for p in parts:
        assert p.n_turns == p.formatted.count(chat.OPEN) == p.formatted.count(chat.CLOSE)
        assert not any(m in p.formatted.replace(chat.OPEN, "").replace(chat.CLOSE, "") for m in chat.CONTROL)


def test_assembly_of_slices():
    roles, texts = pa.array(["skipped", "a", "bé", ""]).slice(1), pa.array(["skipped", "x", "", "ÿ"]).slice(1)
    buffer, ends, spans = chat.assemble(roles, texts)
    want = "".join(f"{chat.OPEN}{r}\n{t}{chat.CLOSE}" for r, t in (("a", "x"), ("bé", ""), ("", "ÿ")))
    assert buffer.tobytes().decode() == want and ends[-1] == len(buffer)
    assert [buffer[a:b].tobytes().decode() for a, b in spans] == ["x", "", "ÿ"]


def test_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
