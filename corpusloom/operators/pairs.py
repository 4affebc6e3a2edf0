"""The best items of each query where every item counts: blocks of queries meet blocks of items, and only each block's best leave it.

A row a pair, or a row a slot that a pair shares, would be shuffled and ranked otherwise.  Spark deals both sides to blocks of bounded size and
ranks what the blocks return; inside a block a pair costs a few steps of Numpy.  Nothing is pruned by a guess: a block returns all that can be
among the best ``k`` once scores are rounded to ``DIGITS``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items and queries of a block, about.
ITEMS, QUERIES = 4096, 4096
#: Pairs that are scored at once.
PAIRS = 1 << 20
DIGITS = 6
#: Scores that differ by more than this keep their order when they are rounded.
MARGIN = 2.0 * 10.0**-DIGITS

#: (two columns of query vectors, two of item vectors, item ids, k) -> for each query with hits: its row, rows of items, scores (nan: null).
Kernel = Callable[..., Iterator[tuple[int, np.ndarray, list]]]


def deal(queries: DataFrame, items: DataFrame, query: str, item: str, on: tuple[str, ...], n_items: int = ITEMS, n_queries: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Both sides with _turn and _part: every query meets every item with equal ``on`` columns in one block, of about so many rows a side."""
    parts = items.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(n_items)).cast("int").alias("_parts"))
    turns = queries.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(n_queries)).cast("int").alias("_turns"))
    sizes = turns.join(parts, list(on))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, list(on)).withColumn("_turn", own(query, "_turns")).withColumn("_part", each("_parts"))
    p = items.join(sizes, list(on)).withColumn("_part", own(item, "_parts")).withColumn("_turn", each("_turns"))
    return q.drop("_parts", "_turns"), p.drop("_parts", "_turns")


def best(queries: DataFrame, items: DataFrame, query: str, item: str, on: tuple[str, ...], k: int, kernel: Kernel, n_items: int = ITEMS, n_queries: int = QUERIES) -> DataFrame:
    """(query, item, score double, not rounded) with the best ``k`` items of each query among them.  Sides: id, *on, columns of the vector."""
    q, p = deal(queries, items, query, item, on, n_items, n_queries)
    return met(q, p, query, item, (*on, "_turn", "_part"), [c for c in items.columns if c not in (item, *on)], k, kernel)


def met(queries: DataFrame, items: DataFrame, query: str, item: str, keys: tuple[str, ...], vector: list[str], k: int, kernel: Kernel) -> DataFrame:
    """``best`` of each block; a block is what has equal ``keys``, and is held by one task."""
    import pyarrow as pa

    fields = [queries.schema[query], items.schema[item]]

    def run(q, p):
        ids = p.column(item).combine_chunks()
        out = list(kernel([q.column(c).combine_chunks() for c in vector], [p.column(c).combine_chunks() for c in vector], ids.to_numpy(zero_copy_only=False), k)) if q.num_rows and p.num_rows else []
        at = np.repeat(np.array([i for i, _, _ in out], np.int64), [len(rows) for _, rows, _ in out]) if out else np.array([], np.int64)
        to = np.concatenate([rows for _, rows, _ in out]) if out else np.array([], np.int64)
        scores = pa.array([x for _, _, found in out for x in found], pa.float64())
        return pa.table([q.column(query).combine_chunks().take(pa.array(at)), ids.take(pa.array(to)), scores], names=[query, item, "score"])

    schema = type(queries.schema)(fields).add("score", "double")
    apart = lambda rows: rows.select(*(F.col(c).alias(c) for c in rows.columns)).groupBy(*keys)  # noqa: E731  (both sides can come from one table)
    return apart(queries).cogroup(apart(items)).applyInArrow(run, schema)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all that can be among the best ``k`` by rounded score and then by id; of equal scores the ``k`` smallest ids."""
    found = np.arange(len(scores))
    if len(scores) > k:
        order = np.where(np.isnan(scores), np.inf, scores)  # as Spark sorts it
        with np.errstate(invalid="ignore"):
            found = np.flatnonzero(order >= np.partition(order, -k)[-k] - MARGIN)
        if len(found) > k:
            found = found[np.lexsort((ids[found], -order[found]))]
            starts = np.flatnonzero(np.r_[True, order[found[1:]] != order[found[:-1]]])
            nth = np.arange(len(found)) - np.repeat(starts, np.diff(np.r_[starts, len(found)]))
            found = found[nth < k]
    return found


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values as doubles with nan for null) of a column of lists; a null list has no values."""
    offsets = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
    return offsets, column.flatten().to_numpy(zero_copy_only=False)


def _by_length(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length.  A null vector, or one that holds a null, is in none."""
    offsets, values = _lists(column)
    values = values.astype(np.float64)
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, np.diff(offsets))
    if column.flatten().null_count:
        gaps = np.flatnonzero(column.flatten().is_null().to_numpy(zero_copy_only=False))
        lengths[np.searchsorted(offsets, gaps, side="right") - 1] = -1
    out = {}
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        out[int(n)] = rows, values[offsets[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
    return out


def by_dot(q: list, p: list, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list]]:
    """Dot products of dense vectors.  Vectors of different length have none, and come after all that have one.

    A matrix product finds who can be among the best; their scores are then added up element by element, as the engine does it."""
    items, everyone = _by_length(p[0]), np.arange(len(ids))
    asked = _by_length(q[0])
    for n, (rows, vectors) in asked.items():
        near, others = items.get(n, (np.array([], np.int64), np.zeros((0, n))))
        rest = np.setdiff1d(everyone, near)
        rest = rest[np.argsort(ids[rest], kind="stable")][:k] if len(near) < k else rest[:0]
        step = max(1, PAIRS // max(1, len(near)))
        for i in range(0, len(rows), step):
            with np.errstate(invalid="ignore", over="ignore"):
                about = vectors[i : i + step] @ others.T
            for row, own, scores in zip(rows[i : i + step], vectors[i : i + step], about, strict=True):
                rough = np.where(np.isnan(scores), np.inf, scores)
                first = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - MARGIN) if len(rough) > k else np.arange(len(rough))
                with np.errstate(invalid="ignore", over="ignore"):
                    exact = np.cumsum(others[first] * own, axis=1)[:, -1] if n else np.zeros(len(first))
                keep = top(exact, ids[near[first]], k)
                yield int(row), np.r_[near[first[keep]], rest], [*exact[keep].tolist(), *[None] * len(rest)]
    # Queries without a vector score nothing with anybody.
    least = np.argsort(ids, kind="stable")[:k]
    for row in np.setdiff1d(np.arange(len(q[0])), np.concatenate([r for r, _ in asked.values()]) if asked else np.array([], np.int64)):
        yield int(row), least, [None] * len(least)


def by_slots(q: list, p: list, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list]]:
    """Dot products of sparse vectors (slots, weights) that share a slot: a query adds up its slots' lists of items."""
    offsets, slots = _lists(p[0])
    order = np.argsort(slots, kind="stable")
    own = np.repeat(np.arange(len(ids)), np.diff(offsets))[order]
    weights, known = _lists(p[1])[1][order], slots[order]
    starts = np.flatnonzero(np.r_[True, known[1:] != known[:-1]]) if len(known) else np.array([], np.int64)
    names, ends = known[starts], np.r_[starts[1:], len(known)].astype(np.int64)
    at, asked = _lists(q[0])
    asked_weights = _lists(q[1])[1]
    for row in range(len(q[0])):
        mine, by = asked[at[row] : at[row + 1]], asked_weights[at[row] : at[row + 1]]
        place = np.searchsorted(names, mine)
        hit = np.flatnonzero((place < len(names)) & (names[np.minimum(place, len(names) - 1)] == mine)) if len(names) else []
        if not len(hit):
            continue
        lists = [slice(starts[j], ends[j]) for j in place[hit]]
        to = np.concatenate([own[x] for x in lists])
        shares = np.concatenate([weights[x] * w for x, w in zip(lists, by[hit], strict=True)])
        sums, seen = np.bincount(to, shares, len(ids)), np.zeros(len(ids), bool)
        seen[to] = True
        found = np.flatnonzero(seen)
        keep = found[top(sums[found], ids[found], k)]
        yield row, keep, sums[keep].tolist()
