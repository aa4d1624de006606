import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillon.llm import conversations as c

TEXTS = st.lists(st.sampled_from([*"a%<|3C25>\n é😀", c.START, c.END, c.PLACEHOLDER["image"], "%3C|"]), max_size=12).map("".join)


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_round_trip(turns):
    formatted = "".join(c.format_turn(r, t)[0] for r, t in turns)
    assert [(r, c.unescape(t)) for r, t, _ in c.parse(formatted)] == turns
    assert formatted.count(c.START) == len(turns) == formatted.count(c.END)


def test_parts_are_flattened_in_order():
    parts = [{"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "a.png", "width": 560, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 4}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": None}]
    flat = c.PartVisitor().visit(parts)
    assert flat.text == "see %3C|image|> <|image|><|audio|><|document|>"
    assert [(a["index"], a["ref"], a["tokens"]) for a in flat.attachments] == [(0, "a.png", 20), (1, "b.wav", 50), (2, "c.pdf", 1680)]
    assert flat.expanded_tokens == 1750
    with pytest.raises(ValueError):
        c.PartVisitor().visit([{"type": "video"}])
    assert c.PartVisitor().visit(None).text == ""


def test_typed_table(spark):
    row = (1, 0, "user", [{"type": "image", "ref": "x", "width": 28, "height": 28}, {"type": "text", "text": "hi"}])
    df = spark.createDataFrame([row], f"conv_id long, turn long, role string, text array<{c._PART}>")
    got = c.format_turns(df).first()
    assert got.formatted == "<|im_start|>user\n<|image|>hi<|im_end|>\n" and got.expanded_tokens == 1 and got.attachments[0].ref == "x"


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: [(x is not None, x or 0 if i == 0 else x or "") for i, x in enumerate(r[1:])])
        text = [(role or "", t or "") for _, _, role, t in turns]
        loss = "".join(t for r, t in text if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in text).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (2, 3, "assistant", ""), (None, 0, "assistant", "né 😀"), (3, 0, "assistant", "long " * 50_000), (3, 1, "assistant", c.END + c.START)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS n_turns")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.read_back(c.format_turns(df)).collect()}
    assert got == expected(rows)
    assert c.read_back(c.format_turns(df.limit(0))).count() == 0
