"""Operator 5: language-model scoring by a hidden Markov model.

Words (A-Z as a-z, cut at ASCII white space, an end after the last) are counted over all learning texts (``blocks``).
Words that make up at least 1 / ``FREQUENT`` of all tokens, so at most FREQUENT of them, are symbols of their own; every
other word belongs to one of ``CLASSES`` classes by its last three bytes.  A state emits a symbol; a class emits its
words by their smoothed share of the class's count, with room for one unknown word.  So the model spreads its
probability over all words, and its size is bounded whatever the corpus.

Baum-Welch: each task runs scaled forward and backward recursions over its texts and adds up expected counts; the counts
are summed in slices across tasks, and only their sum comes to the driver.  Every learning text takes part in every
iteration.  Scores are exact likelihoods by the scaled forward recursion over the whole text.

Texts of similar length run together, step by step, a vector of texts at a time; memory is bounded by ``TOKENS`` tokens (one
text at least).

Defined results: null text is empty text, whose only token is the end; repeated rows are learned and scored as often as they
occur; without learning texts both scores follow from the smoothing alone; an empty table gives an empty table; a null id
counts as the empty text in the split; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.blocks import block_count, lookup, lookup_table, totals, unpack_sorted
from corpusloom.llm.common import arrow_texts, crc_of_id, enter, free_shuffles, groups_by_bytes, materialize, text_or_empty
from corpusloom.llm.langid import arrow_batches
from corpusloom.llm.textvec import SPACED, words_and_tails

U = np.uint64
CLASS_BITS = 12
CLASSES = 1 << CLASS_BITS
FREQUENT = 8192
STATES = 8
ITERATIONS = 4
STICKY = 0.95
SMOOTH = 100.0  # tokens' worth of the overall distribution in each state's
SLICES = 16
SEED = 11
TOKENS = 400_000
STEP = 1 << 20
#: The end of a text: a token that no word has (class 0 of its own hash).
END = U(0xA5A5A5A5A5A5A000)


def text_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token of each word and end in order, tokens of each text).  A token's low bits are its word's class."""
    h, counts, tails = words_and_tails(texts, SPACED)
    group = (tails * np.uint32(0x9E3779B1)) >> np.uint32(32 - CLASS_BITS)
    tokens = (h & ~U(CLASSES - 1)) | group.astype(U)
    ends = np.cumsum(counts)
    return np.insert(tokens, ends, END), counts + 1


def _text_rows(table) -> Iterator[tuple[int, int, list[bytes]]]:
    column = table.column("text").combine_chunks()
    texts = arrow_texts(column)
    for a, b in groups_by_bytes(texts, STEP):
        yield a, b, texts[a:b]


def _block_tokens(table) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a block with their counts in learning texts."""
    held = np.asarray(table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool)
    parts, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b, texts in _text_rows(table):
        x, n = text_tokens(texts)
        u, inverse = np.unique(x, return_inverse=True)
        parts.append(u)
        counts.append(np.bincount(inverse, weights=np.repeat(~held[a:b], n), minlength=len(u)).astype(np.int64))
    u, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return u, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


@dataclass
class Vocabulary:
    """frequent: sorted tokens with symbols 0, 1, ...; class c is symbol len(frequent) + c.  counts, types: of each symbol,
    over learning tokens; types counts distinct words of a class."""

    frequent: np.ndarray
    counts: np.ndarray
    types: np.ndarray
    n: int
    v: int

    def symbols(self, tokens: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, log10 probability of the word given its symbol) of each token; ``c`` are its counts."""
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        own = self.frequent[at] == tokens
        symbol = np.where(own, at, len(self.frequent) + (tokens & U(CLASSES - 1)).astype(np.int64))
        inside = np.log10((c + 0.5) / (self.counts[symbol] + 0.5 * (self.types[symbol] + 1.0)))
        return symbol.astype(np.uint16), np.where(own, 0.0, inside)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    @property
    def shares(self) -> np.ndarray:
        return (self.counts + 0.5) / (self.counts + 0.5).sum()


def vocabulary(back: DataFrame) -> Vocabulary:
    """Symbols and their counts from the stored totals.  The driver gets a row for each class and each frequent word."""
    import pyarrow as pa

    def fresh(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        x, n = unpack_sorted(batch.column(0)[k].as_py()), np.frombuffer(batch.column(1)[k].as_py(), "<u8").astype(np.int64)
        keep = np.unpackbits(np.frombuffer(batch.column(2)[k].as_py(), np.uint8), count=len(x)).astype(bool) & (n > 0)
        return x[keep], n[keep]

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                x, c = fresh(batch, k)
                at = (x & U(CLASSES - 1)).astype(np.int64)
                n += np.bincount(at, weights=c, minlength=CLASSES).astype(np.int64)
                v += np.bincount(at, minlength=CLASSES)
        full = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), pa.array(v[full])], ["class", "n", "v"])

    rows = back.select("tokens", "totals", "first")
    sums = rows.mapInArrow(by_class, "class int, n bigint, v bigint").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    counts, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        counts[r["class"]], types[r["class"]] = r["n"], r["v"]
    total, distinct = int(counts.sum()), int(types.sum())
    least = max(1, -(-total // FREQUENT))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, c = fresh(batch, k)
                x, c = x[c >= least], c[c >= least]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(c)], ["token", "n"])

    found = {int(np.int64(r["token"]).view(U)): r["n"] for r in rows.mapInArrow(common, "token bigint, n bigint").collect()}  # at most FREQUENT
    end = int(END)
    frequent = np.array(sorted({*found, end}), U)
    for t, n in found.items():
        counts[t % CLASSES] -= n
        types[t % CLASSES] -= 1
    if end not in found and total:  # the end, when it is rare, still is a symbol of its own
        n = rows_of(rows, fresh, END)
        found[end] = n
        counts[end % CLASSES] -= n
        types[end % CLASSES] -= 1
    own = np.array([found.get(int(t), 0) for t in frequent], float)
    return Vocabulary(frequent, np.concatenate([own, counts]), np.concatenate([np.ones(len(frequent)), types]), total, distinct)


def rows_of(rows: DataFrame, fresh, token: np.uint64) -> int:
    """Count of one token."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, c = fresh(batch, k)
                yield pa.RecordBatch.from_arrays([pa.array(c[x == token])], ["n"])

    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def sequences(dealt: DataFrame, back: DataFrame, vocab: Vocabulary, id_type: str) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, inside, symbols) of each row; symbols are unsigned 16-bit integers."""
    import pyarrow as pa

    shared = dealt.sparkSession.sparkContext.broadcast(vocab)
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "inside", "symbols"]

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        enter("blocks")
        v, out = shared.value, []
        x, total = lookup_table(counts)
        ids, held = (table.column(c).combine_chunks() for c in ("id", "held_out"))
        for a, b, texts in _text_rows(table):
            tokens, n = text_tokens(texts)
            c = lookup(tokens, x, total)
            symbol, inside = v.symbols(tokens, c)
            cuts = np.concatenate([[0], np.cumsum(n)])
            add = lambda y, cuts=cuts: pa.array(np.add.reduceat(y, cuts[:-1]))
            data = symbol.astype("<u2").tobytes()
            blobs = pa.array([data[2 * i : 2 * j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
            out.append(pa.table([ids.slice(a, b - a), held.slice(a, b - a), pa.array(n), add((c > 0).astype(np.int64)), add(v.base(c)), add(inside), blobs], names))
        return pa.concat_tables(out)

    schema = f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, inside double, symbols binary"
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)


class HMM:
    """start (K), move (K x K), emit (K x symbols)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray, states: int) -> HMM:
        """States that differ a little, at random but always alike, and seldom change."""
        noise = np.random.default_rng(SEED).normal(0.0, 0.5, (states, len(shares)))
        emit = shares * np.exp(noise)
        move = np.full((states, states), (1.0 - STICKY) / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, STICKY if states > 1 else 1.0)
        return cls(np.full(states, 1.0 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def groups(self, seqs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place of each text, steps' begins, symbols, texts) with the symbols of all texts' first steps, then second ..."""
        order = np.argsort([-len(s) for s in seqs], kind="stable")
        begin = 0
        while begin < len(order):
            end, total = begin, 0
            while end < len(order) and (end == begin or total + len(seqs[order[end]]) <= TOKENS):
                total += len(seqs[order[end]])
                end += 1
            own = order[begin:end]
            n = np.array([len(seqs[i]) for i in own])
            live = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts longer than t
            at = np.concatenate([[0], np.cumsum(live)])
            t = np.concatenate([np.arange(k) for k in n])
            who = np.repeat(np.arange(len(n)), n)
            flat = np.empty(total, np.int64)
            place = at[t] + who
            flat[place] = np.concatenate([seqs[i] for i in own])
            text = np.empty(total, np.int64)
            text[place] = who
            yield own, at, flat, text
            begin = end

    def forward(self, at: np.ndarray, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state probabilities after each step, probability of each step's symbol given what came before)."""
        alpha, scale = np.empty_like(likely), np.empty(len(likely))
        bounds = at.tolist()
        prior = self.start
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            a = (prior if b == 0 else prior[: e - b] @ self.move) * likely[b:e]
            s = a.sum(axis=1)
            prior = np.divide(a, s[:, None], out=alpha[b:e])
            scale[b:e] = s
        return alpha, scale

    def log10(self, seqs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence."""
        out, emit = np.zeros(len(seqs)), np.ascontiguousarray(self.emit.T)
        for own, at, flat, text in self.groups(seqs):
            _, scale = self.forward(at, emit[flat])
            out[own] = np.bincount(text, weights=np.log10(scale), minlength=len(own))
        return out

    def expect(self, seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit_counts: np.ndarray) -> float:
        """Add the expected counts of these sequences; returns their log10 probability."""
        emit, total = np.ascontiguousarray(self.emit.T), 0.0
        back = np.ascontiguousarray(self.move.T)
        for _, at, flat, _ in self.groups(seqs):
            likely = emit[flat]
            alpha, scale = self.forward(at, likely)
            total += float(np.log10(scale).sum())
            likely /= scale[:, None]
            pairs = np.zeros_like(move)
            bounds = at.tolist()
            beta = np.ones((bounds[-1] - bounds[-2], len(start)))
            for k in range(len(bounds) - 2, 0, -1):
                b, e = bounds[k], bounds[k + 1]
                ahead = likely[b:e] * beta
                np.multiply(alpha[b:e], beta, out=likely[b:e])  # what is left here are the state probabilities
                p, n = bounds[k - 1], e - b
                pairs += alpha[p : p + n].T @ ahead
                beta = np.ones((b - p, len(start)))
                np.matmul(ahead, back, out=beta[:n])
            np.multiply(alpha[: bounds[1]], beta, out=likely[: bounds[1]])
            start += likely[: bounds[1]].sum(axis=0)
            move += pairs * self.move
            for k in range(len(start)):
                emit_counts[k] += np.bincount(flat, weights=likely[:, k], minlength=emit_counts.shape[1])
        return total


def train(seqs: DataFrame, vocab: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> HMM:
    """Baum-Welch over all rows of ``seqs`` (column symbols)."""
    import pyarrow as pa

    spark, shares = seqs.sparkSession, vocab.shares
    model, size = HMM.first(shares, states), len(shares)
    width = -(-size // SLICES)

    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            enter("hmm")
            m = shared.value
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, size))
            for batch in batches:
                m.expect([np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()], start, move, emit)
            if start.any():
                parts = [emit[:, i * width : (i + 1) * width].tobytes() for i in range(SLICES)] + [np.concatenate([start, move.ravel()]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES + 1), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

        def add(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x in batch.column("counts").to_pylist():
                    x = np.frombuffer(x, np.float64)
                    total = x if total is None else total + x
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])

        parts = seqs.select("symbols").mapInArrow(expect, "slice int, counts binary").groupBy("slice").applyInArrow(arrow_batches(add), "slice int, counts binary")
        found = {r["slice"]: np.frombuffer(r["counts"], np.float64) for r in parts.collect()}  # SLICES + 1 rows
        if not found:
            return HMM(model.start, model.move, np.tile(shares, (states, 1)))
        emit = np.concatenate([found[i].reshape(states, -1) for i in range(SLICES)], axis=1) + SMOOTH * shares
        start, move = found[SLICES][:states] + 1.0, found[SLICES][states:].reshape(states, states) + 1.0
        model = HMM(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
        shared.unpersist()
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens long, base_score and score double; learns where not ``held_out``."""
    import pyarrow as pa

    id_type = docs.schema[id_col].dataType.simpleString()
    blocks = block_count(docs, text_col)
    text = text_or_empty(F.col(text_col))
    dealt = docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("int").alias("block"), F.col(id_col).alias("id"), held_out.alias("held_out"), text.alias("text"))
    back = materialize(totals(dealt, blocks, _block_tokens, least=0), "word-totals")
    free_shuffles(docs.sparkSession)
    vocab = vocabulary(back)
    seqs = materialize(sequences(dealt, back, vocab, id_type), "symbols")
    free_shuffles(docs.sparkSession)
    model = train(seqs.where(~F.col("held_out")), vocab, states, iterations)
    shared, n = docs.sparkSession.sparkContext.broadcast(model), vocab.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("hmm")
        for batch in batches:
            log = shared.value.log10([np.frombuffer(x, "<u2") for x in batch.column(6).to_pylist()]) + np.asarray(batch.column(5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([n] * batch.num_rows, pa.int64()), batch.column(4), pa.array(log)], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return seqs.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: log10 probability of every whole document; learned where crc32(doc_id) mod 5 is not 1."""
    from corpusloom.llm.common import table

    return score(table(spark, sf_dir, "documents"), (crc_of_id(F.col("doc_id")) % 5) == 1)
