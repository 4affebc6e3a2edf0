from __future__ import annotations

import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe
from tests.llm.data import ROWS, documents

PATH = P.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(c: bpe.Codec, text: str) -> list[int]:
    import numpy as np

    return np.frombuffer(c.encode([text.encode()])[0], "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("ab e1'.,sS \n\té́ \x1c<|>İK")), max_size=60))
def test_any_text_as_the_library(text):
    assert ids_of(bpe.codec(PATH), text) == Tokenizer_().encode(text, add_special_tokens=False).ids


def Tokenizer_(cache={}):  # noqa: B006
    if not cache:
        cache[0] = Tokenizer.from_file(PATH)
    return cache[0]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdeéxyzß'1.<|endoftext|>Í"), min_size=1, max_size=200), st.integers(1, 9))
def test_tree_of_any_leaf_size(text, leaf):
    assert bpe.codec(PATH, leaf, 8).encode_unsplit(text) == Tokenizer_().encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdeghilnorstu"), min_size=1, max_size=400), st.integers(1, 30))
def test_tree_joins_words(word, leaf):
    tree, _ = bpe.codec(PATH, leaf)._models()
    assert tree.encode(word) == Tokenizer_().encode(word, add_special_tokens=False).ids


def test_long_unsplit_text(plain):
    for text in ("x" * 50_000, "thequickbrownfox" * 3000, "é" * 9000, "!?" * 7000, "a1b2" * 5000):
        assert ids_of(bpe.codec(PATH), text) == plain.encode(text, add_special_tokens=False).ids


def test_memory_is_dropped_not_wrong(plain):
    c = bpe.Codec(PATH, most=5)
    for _ in range(3):
        for text in ("one two three four five six seven", "eight nine ten one two", "Ünder the dog's 12"):
            assert ids_of(c, text) == plain.encode(text, add_special_tokens=False).ids


def test_other_vocabularies():
    """A byte-level vocabulary: blanks belong to its pre-tokens, so whole texts go to the library and their ids are the library's."""
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    c = bpe.Codec(path)
    assert not c.cuts and c.bare is None
    for text in ("Hello  World\n\nit's 1999", "x" * 6000 + " tail", "", " ", "a<|endoftext|> b", "é  \t"):
        assert ids_of(c, text) == t.encode(text, add_special_tokens=False).ids
    word = "internationalisation" * 50
    assert bpe.TreeBPE(*_model(path), leaf=7).encode(word) == [x.id for x in t.model.tokenize(word)]


def test_models_with_other_options_go_to_the_library(tmp_path):
    import json

    for option in ("ignore_merges", "byte_fallback", "fuse_unk"):
        spec = json.load(open(PATH))
        spec["model"][option] = True
        (tmp_path / "t.json").write_text(json.dumps(spec))
        assert not bpe.Codec(str(tmp_path / "t.json")).cuts
    assert bpe.codec(PATH).cuts


@pytest.mark.parametrize("unit", ["ab", "thequickbrownfox", "é", "!?", "a1b2"])
def test_tree_runs_on_a_megabyte_without_a_blank(plain, monkeypatch, unit):
    """The tree joins the leaves of each long pre-token; the ids are the library's."""
    joins, join = [], bpe.TreeBPE._join
    monkeypatch.setattr(bpe.TreeBPE, "_join", lambda self, *a: joins.append(1) or join(self, *a))
    text = unit * ((1 << 20) // len(unit.encode()))
    assert ids_of(bpe.Codec(PATH), text) == plain.encode(text, add_special_tokens=False).ids
    assert unit == "a1b2" or len(joins) > 100


def test_long_texts_are_cut_at_blanks_only(monkeypatch, plain):
    monkeypatch.setattr(bpe, "STEP", 50)
    words = "one, two three's 4 (five)\tsix " * 40 + "x" * 500 + "\n end."
    c = bpe.Codec(PATH)
    ids, counts = c.encode_flat([t.encode() for t in (words, "", "a", words)])
    want = [plain.encode(t, add_special_tokens=False).ids for t in (words, "", "a", words)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("abe1'.,S    \n\té\u0301 <|>endoftxİ")), max_size=300), st.integers(2, 40), st.integers(1, 9), st.integers(2, 30))
def test_halves_of_any_text(text, half, window, long):
    c = bpe.codec(PATH, 4, long)
    ids, counts = c.encode_tree([b"", text.encode(), text[::-1].encode()], half, window)
    want = [Tokenizer_().encode(t, add_special_tokens=False).ids for t in ("", text, text[::-1])]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_long_texts_are_halved_and_joined(spark, plain, monkeypatch):
    c, joins, join = bpe.Codec(PATH), [], bpe.Codec._join_parts
    monkeypatch.setattr(bpe.Codec, "_join_parts", lambda self, j, w: joins.append(len(j)) or join(self, j, w))
    texts = ["one, two three's 4 (five)\tsix " * 9000, "é" * 20_000, "short", "word " * 300 + "x" * 9000 + " tail" * 2000, "a<|endoftext|>b" * 900 + " end"]
    ids, counts = c.encode_tree([t.encode() for t in texts])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert sum(joins) > 60 and len(joins) >= 7


def _model(path):
    import json

    m = json.load(open(path))["model"]
    return m["vocab"], m["merges"], m.get("end_of_word_suffix") or ""


def test_awkward_rows(spark, plain):
    got = bpe.encode_decode(documents(spark), outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    want = []
    for i, text, *_ in ROWS:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, plain.decode(ids, skip_special_tokens=False)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=order) == sorted(want, key=order)
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_decode(documents(spark, [])).count() == 0


def test_query_on_a_whole_table(spark, tiny, plain):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = bpe.query(spark, tiny).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = plain.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
