import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexloom.llm import chatfsm, queries
from lexloom.llm.chatfsm import INSTRUCT, Machine, Reader, Template, Turn

SF = "/root/testdata/sf0.01"


def brute(rows):
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    out = set()
    for c, turns in by.items():
        said = "".join(x for r, x in turns if r == "assistant")
        out.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = queries.op10_chat_format(spark, SF).collect()
    assert {tuple(r)[:5] for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})
    assert all(r["formatted_chars"] > 0 for r in got)


ODD = [(1, 0, "user", None), (1, 1, None, "x"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (2, None, "system", ""), (None, 0, "tool]\\ [/TURN]", "[TURN=a] \\ [/TURN]"), (3, 0, "user", "y " * 200000), (3, 1, "assistant", " <s> </s>\\<")]


def test_odd_rows(spark):
    turns = spark.createDataFrame([(*r, "extra") for r in ODD], "conv_id long, turn long, role string, text string, valid string")
    got = chatfsm.digests(turns).collect()
    assert {tuple(r)[:5] for r in got} == brute(ODD)
    assert {r["conv_id"]: r["valid"] for r in got} == {1: False, 2: False, None: False, 3: True}
    parts = chatfsm.segments(turns)
    whole = {}
    for r in parts.collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["text"]
    assert {r["conv_id"]: r["formatted_chars"] for r in got} == {c: len(x) for c, x in whole.items()}
    for conv, text in whole.items():  # the whole formatted text, read back at once, has the turns of the digest
        reader = Reader(INSTRUCT)
        said = "".join(f"{r}\n{x}\n" for r, x, _ in reader.feed(text))
        assert not reader.rest and hashlib.sha256(said.encode()).hexdigest() == next(r["turns_sha256"] for r in got if r["conv_id"] == conv)
    assert chatfsm.digests(turns.limit(0)).collect() == [] and chatfsm.segments(turns.limit(0)).collect() == []


pieces = st.lists(st.sampled_from([*INSTRUCT.controls, "\\", "[", "]", "<", ">", "/", " ", "a", "\n", "TURN=", "e"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), pieces), pieces), max_size=6))
def test_whole_conversations_are_read_back(turns):
    machine = Machine(INSTRUCT)
    formatted = "".join(s.text for r, x in turns for s in machine.turn(r, x))
    reader = Reader(INSTRUCT)
    assert [(r, x) for r, x, _ in reader.feed(formatted)] == turns and not reader.rest


@given(pieces)
def test_escaped_text_holds_no_control_string(text):
    escaped = INSTRUCT.escaped(text)
    assert INSTRUCT.unescaped(escaped) == text and not any(c in escaped for c in INSTRUCT.controls)


def test_order_of_turns():
    def valid(*roles):
        m = Machine(INSTRUCT)
        for r in roles:
            m.turn(r, "x")
        return m.complete

    assert valid("user", "assistant") and valid("system", "user", "assistant", "user", "assistant")
    assert not valid("assistant") and not valid("user", "user") and not valid("user") and not valid("user", "assistant", "system")


def test_overlapping_control_strings_are_refused():
    with pytest.raises(ValueError):
        Template({"user": Turn("aba ", " bab", False, ("start",))}).escaped("x")
