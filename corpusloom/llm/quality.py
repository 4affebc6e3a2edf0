"""Operator 10: quality classifier, naive Bayes support vectors (NBSVM).

Features are indicators of the byte n-grams (2 to 4 bytes, case kept) of the whole text, hashed to ``BUCKETS`` columns, and
of its word n-grams that say one word ``REPEATS`` times in a row, whichever word it is (one column for each length).
Each indicator is scaled by its column's class log-count ratio; rows are scaled to unit length.  A linear model with
hinge loss is fitted by dual coordinate descent, its margins become scores through a fitted logistic curve.

The fit uses at most ``MAX_TRAIN`` labelled rows, those with the smallest hash of their id: the bound of the sample is
this parameter.  Each row is kept as a bitmap of ``BUCKETS`` bits, so the one task that fits holds MAX_TRAIN * 8 KiB
whatever the texts' lengths.  The sample is broadcast to find its texts (bounded by the same parameter); the model, two
vectors of ``BUCKETS`` floats, is broadcast for scoring, which is one pass without a shuffle.

Defined results: null text scores as empty text, which has no feature, so its score is that of the bias alone; rows with
a null label or a label other than 0 and 1 are not learned from; a document labelled twice counts twice; without rows of
both classes every score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_texts, crc_of_id, enter, groups_by_bytes, text_or_empty

BITS = 16
BUCKETS = 1 << BITS
REPEATS = (2, 3, 4, 6, 10)
MAX_TRAIN = 4096
EPOCHS = 12
COST = 1.0
SEED = 7
STEP = 1 << 20


def longest_repeat(text: bytes) -> int:
    """Words in the longest run of one word; A-Z count as a-z."""
    words = text.lower().split()
    return 1 + max(map(len, bytes(map(eq, words, words[1:])).split(b"\0")), default=0) if words else 0


def grams(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The buckets (repeats possible) of each text."""
    ends = np.cumsum([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts) + b"\0\0\0", np.uint8).astype(np.uint32)
    x2 = b[:-3] | (b[1:-2] << np.uint32(8))
    x3 = x2 | (b[2:-1] << np.uint32(16))
    x4 = x3 | (b[3:] << np.uint32(24))
    top = np.uint32(BUCKETS - 1 - len(REPEATS))
    h = [np.minimum((x * np.uint32(m)) >> np.uint32(32 - BITS), top).astype(np.uint16) for x, m in ((x2, 0x9E3779B1), (x3, 0x85EBCA77), (x4, 0xC2B2AE3D))]
    for text, end in zip(texts, ends.tolist(), strict=True):
        run = longest_repeat(text)
        repeats = np.array([BUCKETS - 1 - i for i, k in enumerate(REPEATS) if run >= k], np.uint16)
        yield np.concatenate([repeats, *(x[end - len(text) : max(end - k, end - len(text))] for k, x in enumerate(h, 1))])


def bitmaps(texts: list[bytes]) -> list[bytes]:
    out, flags = [], np.zeros(BUCKETS, np.uint8)
    for g in grams(texts):
        flags[:] = 0
        flags[g] = 1
        out.append(np.packbits(flags).tobytes())
    return out


class NBSVM:
    """ratio: log-count ratios; weight: of the scaled indicators; a, b: of the logistic curve."""

    def __init__(self, maps: list[bytes], labels: list[int], epochs: int = EPOCHS, cost: float = COST):
        y = np.array(labels, np.int8)
        counts = np.ones((2, BUCKETS))
        for m, k in zip(maps, labels, strict=True):
            counts[k] += np.unpackbits(np.frombuffer(m, np.uint8))
        logs = np.log(counts / (np.bincount(y, minlength=2)[:, None] + 2.0))
        self.ratio = (logs[1] - logs[0]).astype(np.float32)
        self.square = self.ratio**2
        self._descend(maps, y, epochs, cost)
        self._calibrate(np.array([self._margin(self._row(m)) for m in maps]), y)
        self.scaled = self.weight * self.ratio

    def _row(self, bitmap: bytes) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))

    def _margin(self, at: np.ndarray) -> float:
        r = self.ratio[at]
        length = float(np.sqrt((r * r).sum())) or 1.0
        return float(self.weight[at] @ r) / length + self.bias

    def _descend(self, maps, y, epochs, cost) -> None:
        """Dual coordinate descent for the L1-loss support vector machine; the bias is a feature of value 1."""
        self.weight, self.bias = np.zeros(BUCKETS, np.float32), 0.0
        alpha = np.zeros(len(y))
        share = np.bincount(y, minlength=2) / len(y)
        upper = cost * 0.5 / np.maximum(share, 1e-9)  # both classes weigh the same
        rng = np.random.default_rng(SEED)
        for _ in range(epochs):
            largest = 0.0
            for i in rng.permutation(len(y)):
                at, sign, top = self._row(maps[i]), 1.0 if y[i] else -1.0, upper[y[i]]
                r = self.ratio[at]
                length = float(np.sqrt((r * r).sum())) or 1.0
                r = r / length
                q = 1.0 + (1.0 if len(at) else 0.0)
                gradient = sign * (float(self.weight[at] @ r) + self.bias) - 1.0
                new = min(max(alpha[i] - gradient / q, 0.0), top)
                if (step := new - alpha[i]) != 0.0:
                    alpha[i] = new
                    self.weight[at] += np.float32(step * sign) * r
                    self.bias += step * sign
                    largest = max(largest, abs(step))
            if largest < 1e-3:
                break

    def _calibrate(self, margin: np.ndarray, y: np.ndarray) -> None:
        """Newton steps for p(1) = 1 / (1 + exp(-(a * margin + b))), with smoothed targets."""
        pos, neg = (y == 1).sum(), (y == 0).sum()
        target = np.where(y == 1, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
        theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], axis=1)
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
            theta = theta - step
            if np.abs(step).max() < 1e-9:
                break
        self.a, self.b = map(float, theta)

    def score(self, texts: list[bytes]) -> list[float]:
        out, flags = [], np.zeros(BUCKETS, np.bool_)
        for g in grams(texts):
            flags[g] = True
            at = np.flatnonzero(flags)
            flags[at] = False
            length = float(np.sqrt(self.square[at].sum())) or 1.0
            margin = float(self.scaled[at].sum()) / length + self.bias
            out.append(1.0 / (1.0 + float(np.exp(-min(max(self.a * margin + self.b, -700.0), 700.0)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> NBSVM | None:
    """Learn from the rows of ``labels`` (``id_col``, ``label_col``) and their texts in ``docs``; None without both classes."""
    import pyarrow as pa

    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(max_train)
    )
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_t")).join(F.broadcast(chosen), "_id")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            texts = arrow_texts(batch.column(1))
            for a, b in groups_by_bytes(texts, STEP):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(bitmaps(texts[a:b]), pa.binary())], ["id", "y", "map"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        y, m = [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            m += batch.column(1).to_pylist()
        order = sorted(range(len(y)), key=lambda i: (y[i], m[i]))[:max_train]  # the same model however the rows arrive
        if len(set(y)) == 2:
            model = NBSVM([m[i] for i in order], [y[i] for i in order])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    id_type = docs.schema[id_col].dataType.simpleString()
    sample = rows.select("_id", "_t", "_y").mapInArrow(maps, f"id {id_type}, y int, map binary")
    # Repeated ids can make more rows than were chosen; which of them stay follows from the rows alone.
    chosen = sample.select("y", "map").orderBy(F.xxhash64("map"), "y", "map").limit(max_train)
    found = chosen.coalesce(1).mapInArrow(learn, "model binary").collect()
    if not found:
        return None
    import pickle

    return pickle.loads(found[0]["model"])


def score(docs: DataFrame, model: NBSVM | None, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` (name: column) with score double and predicted int for each row."""
    import pyarrow as pa

    keep = {c: F.col(f"`{c}`") for c in docs.columns} if keep is None else keep
    if model is None:
        return docs.select(*(c.alias(n) for n, c in keep.items()), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared, names = docs.sparkSession.sparkContext.broadcast(model), [*keep, "score", "predicted"]
    frame = docs.select(text_or_empty(F.col(f"`{text_col}`")).alias("_t"), *(c.alias(n) for n, c in keep.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        m = shared.value
        for batch in batches:
            texts = arrow_texts(batch.column(0))
            s = np.array([x for a, b in groups_by_bytes(texts, STEP) for x in m.score(texts[a:b])], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names)

    return frame.mapInArrow(run, frame.drop("_t").schema.add("score", "double").add("predicted", "integer"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more; learned from all of ``labels``' rows about them."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    scored = score(docs, fit(docs, labels, id_col, text_col), text_col, {"_row": row})
    return scored.where(F.col("score") >= least).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: quality of every whole document; learned where crc32(doc_id) mod 3 is not 1."""
    from corpusloom.llm.common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = (crc_of_id(F.col("doc_id")) % 3) == 1
    model = fit(docs, labels.where(~held))
    return score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held})
