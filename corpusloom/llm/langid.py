"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams.

Character n-grams of 1 to 3 code points, lower-cased, with white space and every other non-letter folded to one blank, are
hashed to ``BUCKETS`` columns.  Counts for each language are summed over all learning rows: each task adds up one
matrix (languages x buckets), the matrices are added in slices, and the sum (a few MB, whatever the input) makes the
log-probability matrix that is broadcast.  Texts are scored in numpy, a few MB at a time, as sparse gathers from it.

Prediction: the language with the highest log probability, the alphabetically first on ties; ``und`` if the text is null
or has no letter or if nothing could be learned.  Score: posterior probability at a temperature that counts at most
``EVIDENCE`` n-grams of the text, so that it does not saturate with length; 0 for ``und``.

Defined results: null lang rows are predicted but never learned from; null ids count as the empty text in the split;
repeated rows are learned and predicted as often as they occur; an empty table gives an empty table.  The number of
languages is limited by ``MAX_LANGUAGES`` (an error beyond), which bounds the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_of_id, enter, groups_by_bytes, text_or_empty

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
EVIDENCE = 40
ALPHA = 0.5
MAX_LANGUAGES = 1024
SLICES = 32
STEP = 1 << 20

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to lower-cased letter, everything else to blank (0).  Letters beyond the basic plane keep their code."""
    global _fold
    if _fold is None:
        _fold = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                _fold[i] = ord(low) if len(low) == 1 else i
    return _fold


def grams(texts: list[str], orders=ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, text it belongs to) of some texts; runs of blanks count as one."""
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    x = fold_table()[codes]
    if len(x) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0) | (own[1:] != own[:-1])
    x, own = x[keep], own[keep]
    found, owners = [], []
    for k in orders:
        if len(x) < k:
            continue
        h = np.full(len(x) - k + 1, k, np.uint32)
        for j in range(k):
            h = (h ^ x[j : len(x) - k + 1 + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        same = own[: len(x) - k + 1] == own[k - 1 :]
        if k == 1:
            same &= x != 0
        found.append((h[same] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(buckets).bit_length() + 1))
        owners.append(own[: len(x) - k + 1][same])
    return np.concatenate(found), np.concatenate(owners)


class NaiveBayes:
    """Log-probability matrix of the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, priors: np.ndarray):
        self.languages = languages
        logs = np.log(counts + ALPHA) - np.log(counts.sum(axis=1, keepdims=True) + ALPHA * counts.shape[1])
        self.matrix = np.ascontiguousarray(logs.T.astype(np.float32))
        self.priors = np.log((priors + 1.0) / (priors + 1.0).sum())

    def score(self, texts: list[str]) -> tuple[list[int], list[float], list[bool]]:
        """Best language and score of each text, and whether that language makes the text likelier than n-grams drawn evenly do."""
        h, own = grams(texts)
        n = np.bincount(own, minlength=len(texts))
        sums = np.stack([np.bincount(own, weights=self.matrix[:, k][h], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        logp = sums + self.priors
        best = np.argmax(logp, axis=1)
        tempered = sums * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None] + self.priors
        tempered = np.exp(tempered - tempered.max(axis=1, keepdims=True))
        tempered /= tempered.sum(axis=1, keepdims=True)
        every = np.arange(len(texts))
        return best.tolist(), tempered[every, best].tolist(), (sums[every, best] >= -n * np.log(self.matrix.shape[0])).tolist()


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> NaiveBayes | None:
    """Learn from all rows whose language is not null; None if there are none."""
    import pyarrow as pa

    known = rows.where(F.col(lang_col).isNotNull())
    seen = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not seen:
        return None
    languages = [r["lang"] for r in seen]
    place = {x: i for i, x in enumerate(languages)}
    step = BUCKETS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups_by_bytes(texts, STEP):
                h, own = grams(texts[a:b])
                at = np.array([place[x] for x in langs[a:b]], np.int64)
                total += np.bincount(at[own] * BUCKETS + h, minlength=len(total))
        if total.any():
            parts = total.reshape(len(languages), SLICES, step)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([parts[:, i].astype("<i8").tobytes() for i in range(SLICES)], pa.binary())], ["slice", "counts"])

    def add(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * step, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])

    parts = known.select(text_or_empty(F.col(text_col)), F.col(lang_col)).mapInArrow(count, "slice int, counts binary")
    counts = np.zeros((len(languages), SLICES, step), np.int64)
    for r in parts.groupBy("slice").applyInArrow(arrow_batches(add), "slice int, counts binary").collect():  # SLICES rows
        counts[:, r["slice"]] = np.frombuffer(r["counts"], "<i8").reshape(len(languages), step)
    return NaiveBayes(languages, counts.reshape(len(languages), BUCKETS).astype(np.float64), np.array([r["count"] for r in seen], float))


def arrow_batches(f):
    """Mark a (key, batches) function so that Spark streams the group's batches to it."""
    import pyarrow as pa

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(key, batches)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def predict(docs: DataFrame, model: NaiveBayes | None, text_col: str = "text", keep: dict[str, Column] | None = None, fits: bool = False) -> DataFrame:
    """``keep`` (name: column) with lang_pred string and score double for each row, and with ``fits`` a boolean of that name: false
    for ``und`` and where the text speaks against every language that was learned; one pass, no shuffle."""
    import pyarrow as pa

    keep = {c: F.col(f"`{c}`") for c in docs.columns} if keep is None else keep
    text = F.col(f"`{text_col}`")
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    if model is None:
        und = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("fits")]
        return docs.select(*(c.alias(n) for n, c in keep.items()), *und[: 2 + fits])
    shared, names = docs.sparkSession.sparkContext.broadcast(model), [*keep, "lang_pred", "score", "fits"][: len(keep) + 2 + fits]
    frame = docs.select(text_or_empty(text).alias("_t"), has_letter.alias("_h"), *(c.alias(n) for n, c in keep.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        m = shared.value
        for batch in batches:
            texts, letters = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lang, score, like = [], [], []
            for a, b in groups_by_bytes(texts, STEP):
                best, s, own = m.score(texts[a:b])
                lang += [m.languages[k] if y else "und" for k, y in zip(best, letters[a:b], strict=True)]
                score += [v if y else 0.0 for v, y in zip(s, letters[a:b], strict=True)]
                like += [v and y for v, y in zip(own, letters[a:b], strict=True)]
            found = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(like, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *found[: 2 + fits]], names)

    schema = frame.drop("_t", "_h").schema.add("lang_pred", "string").add("score", "double")
    return frame.mapInArrow(run, schema.add("fits", "boolean") if fits else schema)


def keep_known(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that have a letter and do not speak against every language that was learned; if none was
    learned, all that have a letter."""
    model = fit(docs, text_col, lang_col)
    if model is None:
        return docs.where(F.col(f"`{text_col}`").rlike(r"\p{L}"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return predict(docs, model, text_col, {"_row": row}, fits=True).where("fits").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: predicted language of every whole document; learned where crc32(doc_id) mod 5 is not 0."""
    from corpusloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    held = (crc_of_id(F.col("doc_id")) % 5) == 0
    model = fit(docs.where(~held))
    return predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held})
