"""Chunks with budgets in tokens, against a sequential tokenizer and a sequential chunker."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import text as tx
from corpusloom.functions import tokens
from corpusloom.operators import chunking as ch
from corpusloom.plans import views as v

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def sequential_pieces(sentences, limit=512):
    """One sentence after the other, one token after the other."""
    enc, out = tokens.encoding(PATH), []
    for s in sentences:
        ids = enc.encode_ordinary(s)
        if len(ids) <= limit:
            out.append((s, len(ids)))
            continue
        data = s.encode()
        starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
        at, start = 0, 0
        for i in range(0, len(ids), limit):
            at += len(b"".join(enc.decode_tokens_bytes(ids[i : i + limit])))
            end = min(x for x in starts if x >= at)
            out.append((data[start:end].decode(), len(ids[i : i + limit])))
            start = end
    return out


def sequential_chunks(pieces, size, overlap):
    done, cur = [], []
    for p in pieces:
        if cur and sum(n for _, n in cur) + p[1] > size:
            done.append(cur)
            kept = []
            for q in reversed(cur):
                if sum(n for _, n in kept) + q[1] > overlap:
                    break
                kept.insert(0, q)
            cur = kept if overlap else []
        cur = [*cur, p]
    return [*done, cur] if cur else done


def digest(chunk):
    return hashlib.md5(" ".join(s for s, _ in chunk).encode()).hexdigest(), sum(n for _, n in chunk)


def files(spark, d):
    rows = v.pages(spark, d).where("text IS NOT NULL").select("file_name", tx.sentences(F.col("text")).alias("s")).collect()
    return {r["file_name"]: sequential_pieces(r["s"]) for r in rows}


def test_queries_equal_a_sequential_chunker(spark, tiny):
    own = files(spark, tiny)
    expected = {(f, i, *digest(c)) for f, p in own.items() for i, c in enumerate(sequential_chunks(p, *ch.FIXED))}
    got = catalog.QUERIES["chunk_fixed_tokens"](spark, tiny).collect()
    assert {(r["file_name"], r["chunk_index"], r["text_md5"], r["n_tokens"]) for r in got} == expected and len(got) == len(expected)
    expected = set()
    for f, p in own.items():
        kids = [c for parent in sequential_chunks(p, *ch.PARENT) for c in sequential_chunks(parent, *ch.CHILD)]
        expected |= {(f, i, *digest(c)) for i, c in enumerate(kids)}
    got = catalog.QUERIES["chunk_children_tokens"](spark, tiny).collect()
    assert {(r["file_name"], r["chunk_index"], r["text_md5"], r["n_tokens"]) for r in got} == expected and len(got) == len(expected)


TEXTS = [None, "", "   ", "One. Two! <|endoftext|> stays. Three", "é𝄞ü漢字" * 400, "a" * 30_000, ("word " * 900 + "End. ") * 3, "One. Two! <|endoftext|> stays. Three"]


def test_pieces_of_awkward_texts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(2)
    got = {r["id"]: [tuple(p) for p in r["p"]] for r in rows.select("id", tokens.bpe_pieces(PATH, 7)(F.col("text")).alias("p")).collect()}
    cut = {r["id"]: r["s"] or [] for r in rows.select("id", tx.sentences(F.col("text")).alias("s")).collect()}
    assert len(got) == len(TEXTS) and not got[0] and not got[1] and not got[2]
    assert got == {i: _joined(sequential_pieces(s, 7)) for i, s in cut.items()}
    for i, pieces in got.items():
        assert "".join(p for p, _ in pieces) == "".join(cut[i])
    assert rows.where("false").select(tokens.bpe_pieces(PATH)(F.col("text")).alias("p")).count() == 0


def _joined(pieces):
    """A window without a character of its own counts with the one before it."""
    out = []
    for s, n in pieces:
        if s or not out:
            out.append((s, n))
        else:
            out[-1] = (out[-1][0], out[-1][1] + n)
    return out
