"""Operator 11: substring dedup by relative Lempel-Ziv parsing.

A window of ``WINDOW`` consecutive words is a duplicate if its words also start anywhere else, in the same text or another.  Texts are
factored greedily against indexed reference blocks, each factor the longest match at its place; the windows inside a factor of at least
``WINDOW`` words are duplicates.  A duplicate window that no factor holds whole lies across one boundary between two factors, the second
of which reaches its end; those windows are looked up one by one.  So the spans are exact, whatever the blocks.

No text meets every block: texts and blocks are cut so that equal windows must meet.

* Each window has an anchor, the least hash among its runs of ``ANCHOR`` words (the leftmost of ties), which follows from its words.
  Neighbouring windows of one anchor are a segment of at most 2 * WINDOW - ANCHOR words.  Segments are dealt to reference blocks by their
  anchor, so equal windows meet in one block, and a window is in one segment only.
* Anchors are counted over all texts first (see ``blocks``).  Segments whose anchor occurs once in the corpus go nowhere.
* Equal segments of the texts dealt together are one segment, sent once; their windows are duplicates already.
* An anchor of more than ``HOT`` segments would make a block as large as its passage is common.  Its windows are dealt one by one, by a
  128-bit digest of their words, which is all that is sent of them.
* A block's index is a suffix array over its segments' words with the common prefix of neighbours, both from names of runs of 2, 4, 8 ...
  words, in numpy passes over the whole block.

Whole texts that stand in several rows are factored once, and all their windows are duplicates.

Defined results: null, empty and wordless texts have no words and nothing to remove; texts of fewer than ``WINDOW`` words lose nothing,
however often they occur; repeated rows are copies, each loses its windows; one word repeated over and over is a duplicate of itself;
rows may lack an id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textvec
from corpusloom.llm.blocks import block_count, distinct_texts, lookup, lookup_table, text_key, totals
from corpusloom.llm.common import arrow_texts, enter, groups_by_bytes, materialize
from corpusloom.llm.textvec import SPACED, mix

U = np.uint64
WINDOW = 35
ANCHOR = 8
HOT = 2048
STEP = 1 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, words of each text); words count as they stand."""
    data = b"\n".join(texts) + b"\n"
    b = np.frombuffer(data, np.uint8)
    textvec._powers(len(b))
    flags = np.zeros(len(b) + 1, np.int8)
    flags[1:] = SPACED[b]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[0::2], edges[1::2]
    c = np.zeros(len(b) + 1, U)
    np.cumsum(textvec._table[b] * textvec._pow[: len(b)], out=c[1:])
    h = mix((c[ends] - c[starts]) * textvec._inv[starts] ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, bounds))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; the last k - 1 places have none."""
    out = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k if len(out) else 0):
        out = out * U(0xD1342543DE82EF95) + h[j : len(h) - k + 1 + j]
        out ^= out >> U(29)
    return mix(out)


def least_of(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(least value, its leftmost place) of the w values from each place on."""
    value, place, width = x, np.arange(len(x)), 1
    while width < w:
        by = min(width, w - width)
        n = len(value) - by
        right = value[by:] < value[:n]
        value, place = np.where(right, value[by:], value[:n]), np.where(right, place[by:], place[:n])
        width += by
    return value, place


class Digest:
    """128-bit digests of any range of words, from running sums."""

    def __init__(self, h: np.ndarray):
        textvec._powers(len(h) + 1)
        self.sums = []
        for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
            c = np.zeros(len(h) + 1, U)
            np.cumsum(mix(h ^ U(salt)) * textvec._pow[: len(h)], out=c[1:])
            self.sums.append(c)

    def of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = (end - begin).astype(U) * U(0xA0761D6478BD642F)
        return tuple(mix((c[end] - c[begin]) * textvec._inv[begin] ^ length) for c in self.sums)


class Segments:
    """The segments of some texts: text number, first word (of all), windows, anchor; and which are the first with their words."""

    def __init__(self, texts: list[bytes]):
        parts = [word_hashes(texts[a:b]) for a, b in groups_by_bytes(texts, STEP)]
        self.h = np.concatenate([np.zeros(0, U), *(h for h, _ in parts)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        number = np.repeat(np.arange(len(texts)), self.counts)
        n = max(0, len(self.h) - WINDOW + 1)
        if n:
            anchor, place = least_of(runs(self.h, ANCHOR), WINDOW - ANCHOR + 1)
            whole = number[:n] == number[WINDOW - 1 :]
            new = np.ones(n, bool)
            new[1:] = (place[1:] != place[:-1]) | ~whole[:-1]
            first = np.flatnonzero(new & whole)
            stops = np.flatnonzero(new | ~whole)
            following = np.append(stops, n)[np.searchsorted(stops, first) + 1]
            self.first, self.windows, self.anchor, self.text = first, following - first, anchor[first], number[first]
        else:
            self.first = self.windows = self.text = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, U)
        self.digest = Digest(self.h)
        a, b = self.digest.of(self.first, self.first + self.windows + WINDOW - 1)
        self.sent, self.times = _first_of(a, b)  # places of one segment of each kind, and how often it occurs


def _first_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each pair of values, how often each pair occurs), for all pairs (a, b) in order of their places."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    return order[new], times


def _block_texts(table) -> tuple[list[str], list[bytes]]:
    """(keys, texts) of a block's distinct texts, in the order of their keys, whatever the order of its rows."""
    keys = table.column("key").to_pylist()
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    names = sorted(first)
    return names, arrow_texts(table.column("text").take([first[k] for k in names]).combine_chunks()) if names else []


def _block_anchors(table) -> tuple[np.ndarray, np.ndarray]:
    s = Segments(_block_texts(table)[1])
    return np.unique(s.anchor[s.sent], return_counts=True)


class Reference:
    """The index of a reference block: the longest match of every place with any other place, by a suffix array."""

    def __init__(self, segments: list[list[bytes]]):
        names: dict[bytes, int] = {}
        words = np.fromiter((names.setdefault(w, len(names)) for s in segments for w in s), np.int64)
        sizes = np.array([len(s) for s in segments], np.int64)
        # A segment ends with a word of its own, so that no match reaches beyond it.
        ends = np.cumsum(sizes + 1) - 1
        x = np.empty(int(sizes.sum()) + len(sizes), np.int64)
        own = np.zeros(len(x), bool)
        own[ends] = True
        x[~own] = words
        x[own] = len(names) + np.arange(len(sizes))
        self.begin, self.end = ends - sizes, ends
        longest = int(sizes.max(initial=0)) + 1
        # Names of the runs of 1, 2, 4 ... words from each place on, in the order of the runs.
        levels, width = [np.unique(x, return_inverse=True)[1]], 1
        while width < longest:
            last = levels[-1]
            after = np.zeros(len(x), np.int64)
            after[: len(x) - width] = last[width:] + 1 if len(x) > width else 0
            levels.append(np.unique(last * (len(x) + 1) + after, return_inverse=True)[1])
            width *= 2
        suffixes = np.argsort(levels[-1], kind="stable")
        common = self._common(suffixes[:-1], suffixes[1:], levels)
        self.longest = np.zeros(len(x), np.int64)
        self.longest[suffixes[:-1]] = common
        self.longest[suffixes[1:]] = np.maximum(self.longest[suffixes[1:]], common)

    @staticmethod
    def _common(i: np.ndarray, j: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that the suffixes at i and j have in common, from the longest runs on."""
        i, j, total, n = i.copy(), j.copy(), np.zeros(len(i), np.int64), len(levels[0])
        for k in range(len(levels) - 1, -1, -1):
            inside = (i < n) & (j < n)
            same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
            step = same.astype(np.int64) << k
            i, j, total = i + step, j + step, total + step
        return total

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, begin, end) of the factors of all segments, greedily, one factor of each segment at a time.

        A word that matches nothing is a factor of its own."""
        out = []
        segment, at = np.arange(len(self.begin)), self.begin.copy()
        while len(segment):
            to = np.minimum(at + np.maximum(1, self.longest[at]), self.end[segment])
            out.append((segment, at, to))
            more = to < self.end[segment]
            segment, at = segment[more], to[more]
        s, a, b = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((a, s))
        return s[order], a[order], b[order]

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, begin, end) of duplicate spans, places within the segment."""
        s, a, b = self.factors()
        long = b - a >= WINDOW
        found = [(s[long], a[long], b[long])]
        # Windows across the boundary between a factor and the next, which must reach their end.
        pair = np.flatnonzero(s[1:] == s[:-1])
        low = np.maximum(a[pair] + 1, b[pair] - WINDOW + 1)
        high = np.minimum(b[pair], b[pair + 1] - WINDOW + 1)
        n = np.maximum(0, high - low)
        of = np.repeat(np.arange(len(pair)), n)
        at = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = self.longest[at] >= WINDOW
        found.append((s[pair[of[hit]]], at[hit], at[hit] + WINDOW))
        s, a, b = (np.concatenate([f[i] for f in found]) for i in range(3))
        return s, a - self.begin[s], b - self.begin[s]


#: What blocks send: a segment's words, or (hot anchors) a window's digest.  ``block`` and ``text`` say where it stands, ``first`` its first
#: word there; ``again``: known to be a duplicate, sent for others to find.
SENT = "bucket int, block int, text int, first int, windows int, again boolean, words binary, digest binary"
SPAN = "block int, text int, begin int, end int"


def segments(docs: DataFrame, text_col: str, blocks: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts dealt to blocks, what is sent to the reference blocks); windows known as duplicates have neither words nor digest."""
    import pyarrow as pa

    dealt = distinct_texts(docs, text_col, blocks)
    buckets = 2 * blocks

    def send(table: pa.Table, counts: pa.Table) -> pa.Table:
        enter("substring")
        x, held = lookup_table(counts)
        texts = _block_texts(table)[1] if table.num_rows else []
        block = table.column("block")[0].as_py() if table.num_rows else -1
        s = Segments(texts)
        number = lookup(s.anchor, x, held)
        a, b = s.digest.of(s.first, s.first + s.windows + WINDOW - 1)
        # The copies within the block: all are duplicates, one of each goes on.
        order = np.lexsort((b, a))
        times = np.repeat(s.times, s.times)
        again = np.zeros(len(a), bool)
        again[order] = times > 1
        sent = np.zeros(len(a), bool)
        sent[s.sent] = True
        goes = sent & (number > 1)
        plain = np.flatnonzero(goes & (number <= hot))
        words = [t.split() for t in texts]
        local = s.first - s.begin[s.text]
        bodies = [b" ".join(words[t][f : f + n]) for t, f, n in zip(s.text[plain].tolist(), local[plain].tolist(), (s.windows[plain] + WINDOW - 1).tolist(), strict=True)]
        bucket = lambda v: (mix(v) % U(buckets)).astype(np.int32)
        cols = [(bucket(s.anchor[plain]), s.text[plain], local[plain], s.windows[plain], again[plain], bodies, [None] * len(plain))]
        # Windows of hot anchors, one by one; equal ones of the block are duplicates and go once.
        hots = np.flatnonzero(goes & (number > hot))
        w = s.first[np.repeat(hots, s.windows[hots])] + _within(s.windows[hots])
        d1, d2 = s.digest.of(w, w + WINDOW)
        one, times = _first_of(d1, d2)
        twice = np.repeat(times > 1, times)
        order = np.lexsort((d2, d1))
        of = np.repeat(hots, s.windows[hots])
        known = again[of]
        known[order] |= twice
        flags = np.zeros(len(w), bool)
        flags[one] = True
        at, text = w - s.begin[s.text[of]], s.text[of]
        # One of each goes on; it is known if any of its copies is.
        any_known = np.zeros(len(w), bool)
        if len(w):
            starts = np.flatnonzero(np.append(True, (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])))
            any_known[order] = np.repeat(np.logical_or.reduceat(known[order], starts), np.diff(np.append(starts, len(order))))
        both = np.stack([d1[flags], d2[flags]], 1).astype("<u8")
        cols.append((bucket(d1[flags]), text[flags], at[flags], np.ones(flags.sum(), int), any_known[flags], [None] * int(flags.sum()), [r.tobytes() for r in both]))
        # Duplicates that are known here, as spans: copied segments that stay, and copied windows of hot segments that stay.
        rest = np.flatnonzero(again)
        cols.append((np.full(len(rest), block % buckets, np.int32), s.text[rest], local[rest], s.windows[rest], np.ones(len(rest), bool), [None] * len(rest), [None] * len(rest)))
        rest = np.flatnonzero(any_known)
        cols.append((np.full(len(rest), block % buckets, np.int32), text[rest], at[rest], np.ones(len(rest), int), np.ones(len(rest), bool), [None] * len(rest), [None] * len(rest)))
        n = [len(c[0]) for c in cols]
        flat = [np.concatenate([c[i] for c in cols]) for i in range(5)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        arrays = [pa.array(f, t) for f, t in zip(flat, types, strict=True)]
        arrays.insert(1, pa.array(np.full(sum(n), block), pa.int32()))
        arrays += [pa.array([v for c in cols for v in c[i]], pa.binary()) for i in (5, 6)]
        return pa.table(arrays, ["bucket", "block", "text", "first", "windows", "again", "words", "digest"])

    back = totals(dealt, max(1, blocks // 8), _block_anchors, least=2)
    return dealt, dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(send, SENT)


def _within(n: np.ndarray) -> np.ndarray:
    """0 ... n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def duplicate_spans(sent: DataFrame) -> DataFrame:
    """Each reference block factors its segments, and counts the digests of hot windows: (block, text, begin, end) in words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(table: pa.Table) -> pa.Table:
        enter("substring")
        block, text, first, windows = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("block", "text", "first", "windows"))
        again = np.asarray(table.column("again").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        words, digest = table.column("words").combine_chunks(), table.column("digest").combine_chunks()
        parsed, hot = (np.flatnonzero(pc.is_valid(c).to_numpy(zero_copy_only=False)) for c in (words, digest))
        known = np.ones(len(block), bool)
        known[parsed] = known[hot] = False
        out = [(np.flatnonzero(known), first[known], first[known] + windows[known] + WINDOW - 1)]
        s, a, b = Reference([w.split(b" ") for w in words.take(pa.array(parsed)).to_pylist()]).spans()
        fresh = ~again[parsed[s]]  # the others are among the known ones
        at = parsed[s[fresh]]
        out.append((at, first[at] + a[fresh], first[at] + b[fresh]))
        if len(hot):
            raw = np.frombuffer(b"".join(digest.take(pa.array(hot)).to_pylist()), "<u8").reshape(-1, 2)
            order = np.lexsort((raw[:, 1], raw[:, 0]))
            times = _first_of(raw[:, 0], raw[:, 1])[1]
            at = hot[order[np.repeat(times > 1, times)]]
            at = at[~again[at]]
            out.append((at, first[at], first[at] + WINDOW))
        row, begin, end = (np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(3))
        # Spans of one text that touch are one.
        order = np.lexsort((begin, text[row], block[row]))
        row, begin, end = row[order], begin[order], end[order]
        where = (block[row] << 32) | text[row]
        if len(row):
            base = np.cumsum(np.append(0, where[1:] != where[:-1])) << 40
            reach = np.maximum.accumulate(base + end)
            new = np.append(True, (base[1:] + begin[1:] > reach[:-1]))
            starts = np.flatnonzero(new)
            lasts = np.append(starts[1:], len(row)) - 1
            row, begin, end = row[starts], begin[starts], (reach - base)[lasts]
        return pa.table([pa.array(v, pa.int32()) for v in (block[row], text[row], begin, end)], ["block", "text", "begin", "end"])

    return sent.groupBy("bucket").applyInArrow(run, SPAN)


def deduplicate(docs: DataFrame, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each distinct text, by the text's key: key, n_words, n_removed long, kept binary (its remaining words, joined by one
    space), spans array<struct<begin int, end int>> (ascending, disjoint, in words)."""
    return _texts(docs, text_col, hot, False)


def _texts(docs: DataFrame, text_col: str, hot: int, digest: bool) -> DataFrame:
    import pyarrow as pa

    blocks = block_count(docs, text_col)
    dealt, sent = segments(docs, text_col, blocks, hot)
    spans = duplicate_spans(sent)

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        enter("substring")
        names, texts = _block_texts(table) if table.num_rows else ([], [])
        own: list[list[tuple[int, int]]] = [[] for _ in names]
        for t, a, b in zip(*(found.column(c).to_pylist() for c in ("text", "begin", "end")), strict=True) if found.num_rows else ():
            own[t].append((a, b))
        n_words, n_removed, kept, spans = [], [], [], []
        for text, ranges in zip(texts, own, strict=True):
            words, merged = text.split(), []
            for a, b in sorted(ranges):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            left, at = [], 0
            for a, b in merged:
                left += words[at:a]
                at = b
            left = b" ".join(left + words[at:])
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in merged))
            kept.append(hashlib.sha256(left).hexdigest().encode() if digest else left)
            spans.append([] if digest else [{"begin": a, "end": b} for a, b in merged])
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        return pa.table([pa.array(names, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["key", "n_words", "n_removed", "kept", "spans"])

    schema = "key string, n_words long, n_removed long, kept binary, spans array<struct<begin:int,end:int>>"
    cut_texts = dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, schema)
    # All windows of a text that stands in several rows are duplicates.
    copied = docs.groupBy(text_key(F.col(text_col)).alias("key")).count().where("count > 1").select("key", F.lit(True).alias("copied"))
    met = cut_texts.join(copied, "key", "left")
    gone = F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    empty = F.sha2(F.lit("").cast("binary"), 256).cast("binary") if digest else F.lit("").cast("binary")
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end")))
    either = lambda c, other: F.when(gone, other).otherwise(F.col(c)).alias(c)
    return met.select("key", "n_words", either("n_removed", F.col("n_words")), either("kept", empty), either("spans", whole))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The contract's columns, for each row of ``docs``."""
    texts = materialize(_texts(docs, text_col, hot, True).select("key", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256")), "substring-dedup")
    rows = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("key"))
    return rows.join(texts, "key").select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: duplicate spans of all whole documents, removed."""
    from corpusloom.llm.common import table

    return report(table(spark, sf_dir, "documents"))


SQL = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i::INT AS i, count(*) OVER (PARTITION BY array_to_string(w[i : i + 34], ' ')) AS n FROM numbered, unnest(range(1, len(w) - 33)) t(i)
), gone AS (
  SELECT DISTINCT r, i + j AS p FROM windows, range(35) t(j) WHERE n > 1
), words AS (
  SELECT r, p, w[p] AS word FROM numbered, unnest(range(1, len(w) + 1)) t(p)
), kept AS (
  SELECT words.r, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS text FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM numbered LEFT JOIN kept USING (r)
"""
