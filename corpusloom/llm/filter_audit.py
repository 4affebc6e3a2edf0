"""Operator 13: filter interaction audit by lattice-edge aggregation.

A cascade of filters is a path in the lattice of subsets of filters: from the empty set, each step adds the filter that is applied
next.  What a step does depends on its edge alone, (filters already applied, next filter), not on the order in which those came: with
five filters there are 5 * 2**4 = 80 edges, on which the 5! orders with their 600 steps run.

* A row's failures are a mask, one bit a filter.  Rows are added up by (part, mask) first, 32 masks a part, so an edge's counts are sums
  over at most 32 rows of what all documents contribute to it.
* Edges are joined to the steps of all orders by (subset, filter), both tables of constant size but for the parts.

The last filter of the contract asks whether a smaller id has the same text.  Rows are added up by (text, part, filters failed, labels)
before the texts meet, so a text that a third of all rows share arrives as one row from each task, and only groups, not documents, are
joined to the smallest id of their text.

Defined results: null text counts as empty; a row without an id is no repeat and makes none; rows of equal id and text are no repeats of
each other; a null part is the empty string; ids with several label rows count as labelled if one of them says 1; other columns are
ignored; a part appears if a row has it, with all 600 steps; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.blocks import text_key
from corpusloom.llm.common import UPPER, text_or_empty

LETTERS = "ABCDE"
WORDS = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The contract's conditions that a text alone decides."""
    text = text_or_empty(text)
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_of(conditions: dict[str, Column], letters: str = LETTERS) -> Column:
    """Bit i is set where the i-th filter's condition holds."""
    return sum((F.when(c, F.lit(1 << letters.index(k))).otherwise(F.lit(0)) for k, c in conditions.items()), F.lit(0)).cast("int")


def repeat_masks(rows: DataFrame, bit: int) -> DataFrame:
    """(part, mask, n, good, toxic) of rows (key, id, part, mask, good, toxic), with ``bit`` set for rows whose key a smaller id has."""
    same = ["key", "part", "mask", "good", "toxic"]
    # Equal ids first, so that the rows at a group's smallest id are known; then one row for each group that a text's rows fall into.
    by_id = rows.groupBy("id", *same).agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"), F.min("id").alias("lo"), F.min_by("n", "id").alias("n_lo"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    least = groups.groupBy("key").agg(F.min("lo").alias("least"), F.sum("n").alias("of")).where("of > 1").select("key", "least")
    met = groups.join(least, "key", "left")
    first = F.when(F.col("least").isNull(), F.col("n")).otherwise(F.col("n_null") + F.when(F.col("lo") == F.col("least"), F.col("n_lo")).otherwise(0))
    two = F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - first).alias("n")))
    each = met.select("part", "good", "toxic", F.explode(two).alias("m")).select("part", "m.mask", "m.n", (F.col("good") * F.col("m.n")).alias("good"), (F.col("toxic") * F.col("m.n")).alias("toxic"))
    return add_masks(each.where("n > 0"))


def add_masks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


def lattice(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(mask, subset, filter int, removed, redundant, kept, unique 0 or 1) for each mask and edge: what a row with that mask does there."""
    k, full = len(letters), 1 << len(letters)
    ids = spark.range(full * full * k, numPartitions=1).select((F.col("id") % full).cast("int").alias("mask"), (F.floor(F.col("id") / full) % full).cast("int").alias("subset"), F.floor(F.col("id") / (full * full)).cast("int").alias("filter"))
    bit = F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), F.col("filter") + 1)
    fails, before = F.col("mask").bitwiseAND(bit) > 0, F.col("mask").bitwiseAND(F.col("subset")) > 0
    flags = {"removed": fails & ~before, "redundant": fails & before, "kept": ~fails & ~before, "unique": F.col("mask") == bit}
    return ids.where(F.col("subset").bitwiseAND(bit) == 0).select("mask", "subset", "filter", *(f.cast("int").alias(c) for c, f in flags.items()))


def edges(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts of each part's edges from its masks (part, mask, n, good, toxic)."""
    met = masks.join(F.broadcast(lattice(masks.sparkSession, letters)), "mask")  # of constant size
    sums = {"kept": ("kept", "n"), "removed": ("removed", "n"), "redundant": ("redundant", "n"), "unique_fails": ("unique", "n"), "good_lost": ("removed", "good"), "toxic_lost": ("removed", "toxic")}
    return met.groupBy("part", "subset", "filter").agg(*(F.sum(F.col(a) * F.col(b)).alias(c) for c, (a, b) in sums.items()))


def steps(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(subset, filter, filter_order, step) for each step of each order: the edge that it runs on."""
    rows = []
    for order in permutations(range(len(letters))):
        name, subset = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            rows.append((subset, i, name, step))
            subset |= 1 << i
    return spark.createDataFrame(rows, "subset int, filter int, filter_order string, step int")


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order and step."""
    spark = masks.sparkSession
    found = edges(masks, letters)
    paths = F.broadcast(steps(spark, letters))  # of constant size
    on_paths = found.join(paths, ["subset", "filter"])
    # The removals of a filter over all orders: an edge counts once for each order that runs on it.
    total = on_paths.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return on_paths.join(total, ["part", "filter"]).select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in counts))


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The contract's masks of documents, added up: part, mask, n, good, toxic."""
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    slim = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask_of(failures(F.col(text_col))).alias("mask"))
    labelled = slim.join(marked, "_id", "left").select(F.col("_id").alias("id"), "key", "part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    return repeat_masks(labelled, 1 << LETTERS.index("E"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all orders of the five filters over all whole documents, by source."""
    from corpusloom.llm.common import table

    return audit(document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM words GROUP BY text
), marked AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN firsts USING (text) LEFT JOIN marked USING (doc_id)
), parts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
), letters AS (
  SELECT chr(65 + i::INT) AS letter, (1 << i)::INT AS bit FROM range(5) t(i)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), places AS (
  SELECT filter_order, step::INT AS step, ascii(filter_order[step::INT]) - 65 AS f FROM orders, range(1, 6) t(step)
), walked AS (
  SELECT p.filter_order, p.step, (1 << p.f)::INT AS bit, coalesce(sum((1 << q.f)::INT), 0)::INT AS subset
  FROM places p LEFT JOIN places q ON q.filter_order = p.filter_order AND q.step < p.step GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (subset | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & subset = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & subset > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & subset = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & subset = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM parts, walked GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
