"""Budgets counted in tokens of a byte-level BPE vocabulary, in place of words.

``bpe_pieces`` is a measure that ``operators.chunking.pieces_of_files`` takes.  Sentences are cut by built-in functions; only their
encoding runs in Python, a batch of sentences at once, each of them once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import SENTENCE_TOKENS, sentences

#: Fixed value: how byte-level vocabularies of this family divide a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are encoded at once.
STEP = 1 << 20


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    """The vocabulary of a file of ranks (base64 bytes and number by line); a worker keeps it."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def windows(text: str, token_bytes: list[int], limit: int) -> list[tuple[str, int]]:
    """(text, tokens) of consecutive windows of ``limit`` tokens, given the bytes of each token.

    A character whose bytes two windows share stands whole in the first, so the windows put together are the text."""
    data, out, at, start = text.encode(), [], 0, 0
    for i in range(0, len(token_bytes), limit):
        own = token_bytes[i : i + limit]
        at += sum(own)
        end = max(at, start)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if end > start:
            out.append((data[start:end].decode(), len(own)))
        elif out:
            out[-1] = (out[-1][0], out[-1][1] + len(own))
        start = end
    return out


def _in_steps(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > STEP:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def bpe_pieces(path: str, limit: int = SENTENCE_TOKENS, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """Function of a text column to array<struct<s string, n int>>: its sentences with their tokens; a sentence of more than
    ``limit`` tokens in windows of that size.  Strings of special tokens are ordinary text; a null text has no pieces.

    ``path``: a file of ranks that every executor can open."""
    import numpy as np
    import pyarrow as pa

    def cut(rows: pa.Array) -> pa.Array:
        vocabulary = encoding(path, pattern)
        lists = rows.to_pylist()
        made: list[list[tuple[str, int]]] = []
        for part in _in_steps([s for row in lists for s in row or ()]):
            for s, ids in zip(part, vocabulary.encode_ordinary_batch(part, num_threads=1), strict=True):
                made.append([(s, len(ids))] if len(ids) <= limit else windows(s, [len(vocabulary.decode_single_token_bytes(i)) for i in ids], limit))
        each = iter(made)
        ends = np.cumsum([0, *(sum(len(next(each)) for _ in row or ()) for row in lists)])
        texts, counts = [p for m in made for p, _ in m], [n for m in made for _, n in m]
        items = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["s", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    cut.__annotations__ = {"rows": pa.Array, "return": pa.Array}  # types, not their names, tell Spark what it is given
    run = F.arrow_udf(cut, "array<struct<s:string,n:int>>")
    return lambda text: run(F.coalesce(sentences(text), F.array().cast("array<string>")))
