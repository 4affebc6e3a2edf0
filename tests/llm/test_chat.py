from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import chat

PATH = P.path(chat.VOCABULARY)
NASTY = st.lists(st.sampled_from(["#", "###", "\\", "</turn>", "### User: ", ": ", "\n", "a", "é", "🎈", "<|endoftext|>", " "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape(chat.escape(text, chat.ROLE_CONTROL)) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), NASTY), NASTY), max_size=5))
def test_ids_and_text_read_back(turns):
    t = chat.template(PATH)
    parts = list(t.segments([r for r, _ in turns], [x for _, x in turns]))
    ids = [i for s, _, _ in parts for i in s]
    assert list(t.parse(ids)) == turns
    assert list(chat.parse_text(t.formatted(ids))) == turns
    for (role, text), (s, a, b) in zip(turns, parts, strict=True):
        assert chat.unescape(t.text(s[a:b])) == (text if role == "assistant" else "")


def test_no_text_makes_a_marker():
    t = chat.template(PATH)
    hostile = "".join(chat.MARKERS.values()) + "<|endoftext|>"
    assert max(t.encode([hostile])[0]) < t.first


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, turn long, role string, text string, ids string")


def test_awkward_rows(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, None, None), (None, 0, "assistant", "x"), (None, 1, "assistant", None),
        (3, None, "assistant", "first"), (3, 5, "assistant", chat.HOSTILE), (3, 5, "tool: x", "### "), (4, 0, "assistant", "long " * 30_000),
    ]
    segments = chat.format_turns(frame(spark, rows).repartition(4))
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    assert set(got) == {1, 2, 3, 4, None}

    def digest(*turns):
        return hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()

    assert got[1]["turns_sha256"] == digest(("user", "a"), ("assistant", "b")) and got[1]["loss_chars"] == 1
    assert got[2]["turns_sha256"] == digest(("", ""), ("", "")) and got[2]["loss_chars"] == 0
    assert got[None]["turns_sha256"] == digest(("assistant", "x"), ("assistant", ""))
    assert got[3]["turns_sha256"] == digest(("assistant", "first"), ("assistant", chat.HOSTILE), ("tool: x", "### "))
    assert got[3]["loss_sha256"] == hashlib.sha256(("first" + chat.HOSTILE).encode()).hexdigest()
    assert got[4]["loss_chars"] == 150_000
    for conv, part in {c: [s for s in segments.collect() if s["conv_id"] == c] for c in got}.items():
        part.sort(key=lambda s: s["part"])
        sizes = [len(s["ids"]) for s in part]
        assert [s["token_start"] for s in part] == [0, *np.cumsum(sizes)[:-1].tolist()], conv
        assert all(s["token_start"] <= s["loss_begin"] <= s["loss_end"] <= s["token_start"] + len(s["ids"]) for s in part)


def test_empty_table(spark):
    assert chat.read_back(chat.format_turns(frame(spark, []))).count() == 0


def test_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").orderBy("conv_id", "turn").collect()
    turns: dict = {-7: [("user", chat.HOSTILE), ("assistant", chat.HOSTILE)]}
    for r in rows:
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in chat.query(spark, tiny).collect()}
    assert set(got) == set(turns)
    for c, t in turns.items():
        lost = "".join(x for r, x in t if r == "assistant")
        assert got[c]["n_turns"] == len(t)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
