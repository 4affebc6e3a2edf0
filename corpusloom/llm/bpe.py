"""Operator 6: BPE encoding and decoding, long unsplit text by tree concatenation.

A text of more than ``HALF`` bytes is halved, wherever the middle falls, until its parts are that short; all parts are encoded
in one batch, then neighbours are joined pairwise up the tree.  At a join, a window of the text on either side of the cut is
encoded anew.  It grows until either side of it ends at white space or at the side's end and the side's ids there are those of
its share of the window, so that both sides agree exactly with what the window replaces (``Codec._join_parts``).

Parts are cut at ASCII white space where no pre-token, special token or normalisation of the tokenizer crosses it
(``Codec._cuts_at_blanks``; other tokenizers encode whole texts by the library, so their ids are the library's).  The ids of
a text are then the ids of its pieces in order; every distinct piece is encoded once and remembered.

A long piece without white space may hold a pre-token of any length.  Such a pre-token is cut into leaves.  All leaves
are encoded in one parallel batch; then neighbours are joined pairwise up a tree.  At a join, a window of tokens on
either side is encoded anew.  When the window's encoding begins with the left side's token and ends with the right
side's, both sides agree and the join is exact: a BPE sequence is right if and only if each adjacent pair of it is.
Otherwise the window grows, at most to the whole of both sides.

Defined results: null text is the empty text, which has no ids and decodes to "".  Repeated rows give repeated rows.
Extra columns do not matter: only the named columns are read.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_texts, enter, groups_by_bytes, text_or_empty, tokenizer_path

LEAF = 1024  # characters of a leaf
HALF = 4096  # bytes of text from which it is halved
WINDOW = 16  # bytes on either side of a join at first
LONG = 4096  # bytes of a piece from which it goes to the tree
MEMO = 200_000  # pieces that a worker remembers
STEP = 2 << 20  # bytes of text encoded at once
OUT_STEP = 1 << 20  # bytes of text whose ids and decoded texts are held as Python objects at once
#: Kinds of bytes: 0 the end of a piece, 1 lower-case letters, 2 digits, 3 punctuation but the apostrophe, 4 all others.
KINDS = np.full(256, 4, np.uint8)
KINDS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
KINDS[48:58], KINDS[97:123], KINDS[10] = 2, 1, 0
#: Second bytes, after 0xC3, of the lower-case letters of Latin-1.
LATIN = np.zeros(256, bool)
LATIN[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
BLANK = re.compile(rb"[\t-\r ]")
LAST_BLANK = re.compile(rb"[\t-\r ][^\t-\r ]*\Z")
#: The part of a split pattern, as JSON, that keeps runs of letters and runs of punctuation apart.
LETTERS_SPLIT = r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
VOCABULARY = "word_bpe_49k.json"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _at_blanks(text: bytes, most: int) -> Iterator[bytes]:
    """The text in parts of about ``most`` bytes that end before white space, or where the text ends."""
    at = 0
    while len(text) - at > most and (blank := BLANK.search(text, at + most)):
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:] if at else text


class TreeBPE:
    """BPE of one pre-token of any length by tree concatenation.

    ``vocab`` and ``merges`` are the model's; ``suffix`` is its end-of-word suffix ("" for none).
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, leaf: int = LEAF):
        from tokenizers import Tokenizer, models

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.inner = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.last = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix)) if suffix else self.inner
        self.suffix, self.leaf, self.tokens = suffix, leaf, {i: t for t, i in vocab.items()}

    def _ids(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _text(self, ids: list[int], ends: bool) -> str:
        text = "".join(self.tokens[i] for i in ids)
        return text[: -len(self.suffix)] if ends and self.suffix else text

    def encode(self, piece: str) -> list[int]:
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        level = self._ids(self.inner, leaves[:-1]) + self._ids(self.last, leaves[-1:])
        while len(level) > 1:
            joined = [self._join(level[i], level[i + 1], i + 2 == len(level)) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2 :]
        return level[0]

    def _join(self, a: list[int], b: list[int], ends: bool) -> list[int]:
        k = 1
        while True:
            left, right = a[-k:], b[:k]
            whole_a, whole_b = k >= len(a), k >= len(b)
            closes = ends and whole_b
            window = self._ids(self.last if closes else self.inner, [self._text(left + right, closes)])[0]
            if (whole_a or window[0] == left[0]) and (whole_b or window[-1] == right[-1]):
                return a[: len(a) - len(left)] + window + b[len(right) :]
            k *= 2


class Codec:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids as the tokenizers library does, and decodes them."""

    def __init__(self, path: str, leaf: int = LEAF, long: int = LONG, most: int = MEMO):
        from tokenizers import Tokenizer

        self.path, self.leaf, self.long, self.most = path, leaf, long, most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.spec = spec = json.loads(self.tokenizer.to_str())
        self.cuts = self._cuts_at_blanks()
        marked = all("<|" in a["content"] for a in spec["added_tokens"])  # special tokens can be told by this
        self.lowers = marked and '"Lowercase"' in json.dumps(spec["normalizer"])
        self.bare = self._bare_model()
        self._tree: tuple | None = None
        self.spec = None  # the vocabulary is large

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, counts = self.encode_flat(texts)
        data, cuts = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        return [data[i:j] for i, j in pairwise(cuts)]

    def encode_tree(self, texts: list[bytes], half: int = HALF, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """``encode_flat`` by tree concatenation of the halves of each text longer than ``half`` bytes."""
        if not self.cuts:
            return self.encode_flat(texts)
        bounds = [[0, *self._halves(t, 0, len(t), half), len(t)] for t in texts]
        flat, counts = self.encode_flat([t[i:j] for t, b in zip(texts, bounds, strict=True) for i, j in pairwise(b)])
        if len(counts) == len(texts):
            return flat, counts
        parts = iter(np.split(flat, np.cumsum(counts)[:-1]))
        trees = [[(i, j, next(parts)) for i, j in pairwise(b)] for b in bounds]
        while joins := [(n, i) for n, t in enumerate(trees) for i in range(0, len(t) - 1, 2)]:
            joined = iter(self._join_parts([(texts[n], trees[n][i], trees[n][i + 1]) for n, i in joins], window))
            trees = [[next(joined) if i + 1 < len(t) else t[i] for i in range(0, len(t), 2)] for t in trees]
        return np.concatenate([t[0][2] for t in trees]), np.array([len(t[0][2]) for t in trees], np.int64)

    def _halves(self, text: bytes, i: int, j: int, half: int) -> list[int]:
        """Ascending places at which text[i:j] is halved.  A cut stays out of a run without white space that reaches ``long`` bytes
        to a side: such a run is a piece, whose pre-tokens have a tree of their own."""
        if j - i <= half:
            return []
        at = (i + j) // 2
        while at < j and text[at] & 0xC0 == 0x80:
            at += 1
        near = at - self.long <= i or LAST_BLANK.search(text[at - self.long : at])
        if not (near and (at + self.long >= j or BLANK.search(text, at, at + self.long))):
            after = BLANK.search(text, at, j)
            at = after.start() if after else max(text.rfind(b, i, at) for b in (b"\t", b"\n", b"\v", b"\f", b"\r", b" "))
        return [*self._halves(text, i, at, half), at, *self._halves(text, at, j, half)] if i < at < j else []

    def _join_parts(self, joins: list[tuple], window: int) -> list[tuple[int, int, np.ndarray]]:
        """(begin, end, ids) of each join of (text, left part, right part), parts as (begin, end, ids); all windows of one size are
        encoded in one batch."""
        out: list = [None] * len(joins)
        left = list(range(len(joins)))
        while left:
            tried, windows = [], []
            for n in left:
                text, (begin, cut, _), (_, end, _) = joins[n]
                a, b = max(begin, cut - window), min(end, cut + window)
                if a > begin:
                    blank = LAST_BLANK.search(text[a:cut])
                    a = a + blank.start() if blank else -1
                if b < end:
                    blank = BLANK.search(text, cut, b)
                    b = blank.start() if blank else -1
                if a >= 0 and b >= 0:
                    tried.append(n)
                    windows += [text[a:cut], text[cut:b], text[a:b]]
            flat, counts = self.encode_flat(windows)
            parts = iter(np.split(flat, np.cumsum(counts)[:-1]) if windows else ())
            for n in tried:
                _, (begin, _, a), (_, end, b) = joins[n]
                x, y, both = next(parts), next(parts), next(parts)
                if len(x) <= len(a) and np.array_equal(a[len(a) - len(x) :], x) and np.array_equal(b[: len(y)], y):
                    out[n] = (begin, end, np.concatenate([a[: len(a) - len(x)], both, b[len(y) :]]))
            left = [n for n in left if out[n] is None]
            window *= 2
        return out

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as unsigned 32-bit integers, number of ids of each text).

        A long text is handled in parts that end at white space, so what is held beside the ids is bounded by ``STEP`` and by
        the longest run without white space."""
        owner, parts = [], []
        for i, t in enumerate(texts):
            for part in _at_blanks(t, 2 * STEP) if self.cuts else (t,):
                owner.append(i)
                parts.append(part)
        found = [self._step(parts[a:b]) for a, b in groups_by_bytes(parts, STEP)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(x for x, _ in found)])
        each = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        counts = np.zeros(len(texts), np.int64)
        np.add.at(counts, np.array(owner, np.int64), each)
        return ids, counts

    def _step(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_flat`` of a few texts: their distinct pieces are encoded once, then laid out by position."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.cuts:
            whole = [e.ids for e in self._batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for x in whole for i in x], "<u4"), np.array([len(x) for x in whole], np.int64)
        lists = pc.ascii_split_whitespace(pa.array([self._fold(t) for t in texts], pa.binary()).cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.cast(pa.binary()).to_pylist()
        self._learn(pieces)
        known = list(map(self.memo.__getitem__, pieces))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        place = coded.indices.to_numpy()
        n = size[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin[place] - ends[:-1], n)
        at += np.arange(len(at))
        return pool[at], np.diff(ends[lists.offsets.to_numpy()])

    def _cuts_at_blanks(self) -> bool:
        """Whether this tokenizer encodes the pieces between white space one by one: it drops white space, its pre-tokens hold
        none, and its model has none of the options that the tree does not follow.  Others are encoded whole by the library."""
        model, split = self.spec["model"], json.dumps(self.spec["pre_tokenizer"] or "")
        options = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        normalizers = (self.spec["normalizer"] or {}).get("normalizers", [self.spec["normalizer"]] if self.spec["normalizer"] else [])
        local = all(n["type"] in ("NFC", "Lowercase") or (n["type"], n.get("pattern"), n.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for n in normalizers)
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not re.search(r"\s", a["content"]) for a in self.spec["added_tokens"])
        removes = LETTERS_SPLIT in split and '"Removed"' in split and '"invert": true' in split and '"add_prefix_space": false' in split
        return model["type"] == "BPE" and not any(model.get(o) for o in options) and local and plain and removes

    def _bare_model(self) -> tuple | None:
        """(code point of each byte's letter, the model without normaliser, splitting at blanks only); None for a tokenizer that does not
        mark the ends of its pre-tokens or splits and normalises in another way.  Sets ``ends``: the ids that close one."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, split = spec["model"].get("end_of_word_suffix"), json.dumps(spec["pre_tokenizer"] or "")
        if not (suffix and self.lowers and LETTERS_SPLIT in split and '"ByteLevel"' in split):
            return None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for t, i in spec["model"]["vocab"].items():
            self.ends[i] = t.endswith(suffix)
        bare = Tokenizer(models.BPE(vocab=spec["model"]["vocab"], merges=[tuple(m) for m in spec["model"]["merges"]], end_of_word_suffix=suffix))
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        codes = np.array([ord(byte_letters()[b]) for b in range(256)], "<u4")
        codes[10] = 32  # the end of a piece
        return codes, bare

    def _fold(self, text: bytes) -> bytes:
        """A-Z to a-z where that comes to the same: the tokenizer lowers case, no special token and no combining mark, which
        could make one character with a letter, stands in the text."""
        return text.lower() if self.lowers and b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text else text

    def _learn(self, pieces: list[bytes]) -> None:
        if len(self.memo) > self.most:  # what this step has again is what is worth keeping
            self.memo = {p: self.memo[p] for p in pieces if p in self.memo}
        new = [p for p in pieces if p not in self.memo]
        rest = self._learn_simple(new) if self.bare and new else new
        short = [p for p in rest if len(p) <= self.long]
        for p, e in zip(short, self._batch([p.decode() for p in short], add_special_tokens=False), strict=True):
            self.memo[p] = array("I", e.ids).tobytes()
        for p in rest:
            if len(p) > self.long:
                self.memo[p] = np.array(self.encode_unsplit(p.decode()), "<u4").tobytes()

    def _learn_simple(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of lower-case letters, digits and punctuation are split here, all at once by the kinds of their bytes, and encoded
        many at a time without normalisation, which would leave them as they are; the ids that close a pre-token show where
        each piece ends.  Returns the other pieces."""
        codes, bare = self.bare
        data = np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)
        kind = KINDS[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[LATIN[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = 1
        kind[np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))] = 4  # "<|" begins a special token
        ends = np.flatnonzero(data == 10)
        size = np.diff(ends, prepend=-1)
        good = (np.diff(np.cumsum(kind == 4)[ends], prepend=0) == 0) & (size <= self.long) & (size > 1)
        rest = [pieces[i] for i in np.flatnonzero(~good).tolist()]
        if not good.any():
            return rest
        mine = np.repeat(good, size)
        data, kind = data[mine], kind[mine]
        ends = np.cumsum(size[good]) - 1
        # A run ends where the kind changes, and after each digit.
        cut = np.zeros(len(data), bool)
        cut[:-1] = ((kind[:-1] != kind[1:]) | (kind[:-1] == 2)) & (kind[:-1] != 0) & (kind[1:] != 0)
        before = np.cumsum(cut)[ends]
        closed = before + np.arange(1, len(ends) + 1)  # runs up to the end of each piece
        runs = np.insert(codes[data], np.flatnonzero(cut) + 1, 32)
        ends = ends + before
        names, many = [pieces[i] for i in np.flatnonzero(good).tolist()], 1024
        lasts = ends[many - 1 :: many].tolist() + ([int(ends[-1])] if len(ends) % many else [])
        texts = [runs[a + 1 : b].tobytes().decode("utf-32-le") for a, b in pairwise([-1, *lasts])]
        for i, e in enumerate(bare.encode_batch_fast(texts, add_special_tokens=False)):
            ids, a, b = np.array(e.ids, "<u4"), many * i, many * (i + 1)
            closing = np.flatnonzero(self.ends[ids]) + 1
            at = [0, *(4 * closing[closed[a:b] - (closed[a - 1] if a else 0) - 1]).tolist()]
            held = ids.tobytes()
            self.memo.update(zip(names[a:b], [held[x:y] for x, y in pairwise(at)], strict=True))
        return rest

    def encode_unsplit(self, text: str) -> list[int]:
        """Ids of a text; its pre-tokens longer than a leaf go to the tree."""
        tree, special = self._models()
        out: list[int] = []
        for i, part in enumerate(special.split(text) if special else [text]):
            if i % 2:
                out.append(self.tokenizer.token_to_id(part))
                continue
            t = self.tokenizer
            part = t.normalizer.normalize_str(part) if t.normalizer else part
            pieces = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(part)] if t.pre_tokenizer else [part]
            for p in pieces:
                out += tree.encode(p) if len(p) > self.leaf else [x.id for x in t.model.tokenize(p)]
        return out

    def _models(self) -> tuple:
        if self._tree is None:
            with open(self.path, encoding="utf-8") as f:
                spec = json.load(f)
            model = spec["model"]
            added = sorted((a["content"] for a in spec.get("added_tokens", [])), key=len, reverse=True)
            special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
            self._tree = TreeBPE(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "", self.leaf), special
        return self._tree

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_codecs: dict[tuple, Codec] = {}


def codec(path: str, leaf: int = LEAF, long: int = LONG, most: int = MEMO) -> Codec:
    """One codec for each worker process."""
    if (key := (path, leaf, long, most)) not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def free_codecs() -> None:
    _codecs.clear()


def encode_decode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    outputs: tuple[str, ...] = ("ids", "decoded"),
    leaf: int = LEAF,
    long: int = LONG,
    most: int = MEMO,
) -> DataFrame:
    """``id_col`` and, as named in ``outputs``: ``ids`` array<int>, ``decoded`` string, ``n_tokens`` long, ``ids_sha256`` and
    ``decoded_sha256`` (digests of the ids as decimals joined by one space, and of the decoded text).

    One pass without a shuffle; memory is bounded by ``OUT_STEP`` bytes of text (one text at least) and ``most`` remembered pieces.
    """
    import pyarrow as pa

    path = tokenizer or tokenizer_path(VOCABULARY)
    kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe", free_codecs)
        c = codec(path, leaf, long, most)
        decimals = [str(i) for i in range(c.tokenizer.get_vocab_size() + 1)]
        for batch in batches:
            texts = arrow_texts(batch.column(1))
            for begin, end in groups_by_bytes(texts, OUT_STEP):
                flat, counts = c.encode_tree(texts[begin:end])
                ids = np.split(flat, np.cumsum(counts)[:-1])
                lists = [x.tolist() for x in ids]
                decoded = c.decode(lists) if {"decoded", "decoded_sha256"} & set(outputs) else []
                make = {
                    "ids": lambda ids=ids: pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in ids], dtype=np.int32), pa.array(np.concatenate(ids).astype(np.int32))),
                    "decoded": lambda decoded=decoded: pa.array(decoded, pa.string()),
                    "n_tokens": lambda ids=ids: pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": lambda lists=lists: pa.array([hashlib.sha256(" ".join([decimals[i] for i in x]).encode()).hexdigest() for x in lists], pa.string()),
                    "decoded_sha256": lambda decoded=decoded: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *(make[o]() for o in outputs)], [id_col, *outputs])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{o} {kinds[o]}" for o in outputs)
    return docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: token counts and digests of ids and decoded text of every whole document."""
    from corpusloom.llm.common import table

    return encode_decode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
