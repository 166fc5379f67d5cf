import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from assertia.llm import chat as C
from assertia.llm.queries import format_conversations

NASTY = "\\### Assistant: </turn> ok"
TEXT = st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), st.lists(st.sampled_from(["\\", "<", ">", "\n", "l", "g", "n", "<turn user>", "</turn>"]), max_size=8).map("".join))


@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    out = "".join(C.render(r, t) for r, t in turns)
    assert C.parse(out) == turns
    assert [C._plain(out[a:b]) for a, b in C.loss_spans(out)] == [t for r, t in turns if r == "assistant"]


def test_rejects_damage():
    with pytest.raises(ValueError):
        C.parse(C.render("user", "a") + "x")
    with pytest.raises(ValueError):
        C.parse("x" + C.render("user", "a"))


def test_layouts(spark):
    turns = [("user", "hi"), ("assistant", NASTY)]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in turns]},
        {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in turns]},
        {"prompt": "hi", "response": NASTY},
        {"completion": NASTY, "prompt": "hi"},
        {"output": NASTY, "instruction": "hi"},
    ]
    odd = [{"unknown": {"deep": [1, {"x": None}]}}, [], None, {"role": None, "text": None}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records + odd)] + [(100, "{broken"), (101, None)]
    out = {r.k: r for r in C.canonical(spark.createDataFrame(rows, "k long, record string"), "record", ["k"]).collect()}
    for i in range(len(records)):
        assert [tuple(t) for t in out[i].turns] == turns
    assert out[5].turns is None and out[5].fingerprint == C.fingerprint(["unknown.deep[]", "unknown.deep[].x"])
    assert out[6].fingerprint is None and out[100].turns is None and out[101].turns is None
    assert [tuple(t) for t in out[8].turns] == [("", "")]


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", NASTY), (2, 0, "assistant", None), (3, 0, None, ""), (1, 1, "assistant", NASTY), (4, 2, "user", "é" * 5000), (4, None, "system", "s"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' as segment", "1 as pos")
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv][1:5] == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(C.render(r[2] or "", r[3] or "")) for r in own)
    assert format_conversations(df.limit(0)).count() == 0


def test_layouts_of_one_table_and_records_without_a_mapping(spark):
    """The query's records come in three layouts, told by their fingerprints; a record of an unknown layout keeps its conversation."""
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(["user", "assistant", "system", "human", "system", "gpt", None, None])]
    records = C.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    known = C.canonical(records, "record", ["conv_id", "turn"])
    assert {r.fingerprint for r in known.collect()} == {C.fingerprint(p) for p in (["role", "text"], ["messages[].role", "messages[].content"], ["conversations[].from", "conversations[].value"])}
    assert [tuple(r.turns[0]) for r in sorted(known.collect(), key=lambda r: r.turn)] == [(r or "", t) for _, _, r, t in rows]
    odd = records.unionByName(spark.createDataFrame([(2, 0, '{"who": "x"}'), (1, 9, '{"who": "x"}')], "conv_id long, turn long, record string"))
    keys = ["conv_id", "turn"]
    out = C.format_turns(C.canonical(odd, "record", keys), keys)
    assert out.where("segment is null").count() == 2 and out.count() == len(rows) + 2
    assert {r.conv_id: r.n_turns for r in C.read_back(out).collect()} == {1: len(rows), 2: 0}
