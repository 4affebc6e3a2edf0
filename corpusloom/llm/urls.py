"""Operator 2: URL filters, gradient-boosted trees on lexical features.  DataFrame and SQL functions only.

Host and path are cut from the url by position; curated rules decide first, the longest rule that fits.  What no rule
decides, boosted trees do: features are length, path depth, digit ratio, character entropy, parameter count, hyphens and
dots of the host, and suffix statistics: smoothed log-odds of the last one and two host labels among labelled urls, shrunk
towards 0 as if ``SUFFIX_PRIOR`` more urls had said nothing, so a rare suffix says little and none is left out.

Training: features are cut to ``BINS`` bins at fixed edges; labelled rows with equal bins are one weighted cell.  At most
``MAX_TRAIN`` distinct labelled urls, those with the smallest hash, are learned from (the parameter is the sample's bound),
half of each label where both have that many, else more of the other.  A url weighs as often as it occurs; the labels weigh
in the sample as in all labelled rows.  Every level of every tree is one aggregate over (node, feature, bin) that sums gradients and weights; the driver gets these
sums (nodes x features x bins rows, whatever the input) and picks the splits.  A model is a list of trees and becomes one
CASE expression, so scoring is a projection inside whole-stage code.

The suffix statistics are counted over all labelled rows and have a row for each suffix; how they join is left to the planner.  A url
that is learned from sees statistics of the other ``FOLDS`` - 1 parts of the labelled urls only (parts by hash of the url), so no tree learns
how far a suffix repeats the url's own label; a url that is judged sees the statistics of all.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, and gets the model's verdict
like any other; without labelled urls of both kinds the model allows.  Repeated rows give repeated rows; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, materialize, text_or_empty

#: (host, path, verdict), a rule is written host + path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_TRAIN = 20_000
SUFFIX_PRIOR = 20.0
FOLDS = 5
BINS = 16
TREES, DEPTH, RATE, LAMBDA = 8, 3, 0.4, 1.0
#: Features and the edges between their bins.
EDGES = {
    "length": [20, 24, 28, 32, 36, 40, 44, 48, 54, 60, 70, 80, 100, 150, 250],
    "depth": [1, 2, 3, 4, 5, 6, 8, 12],
    "digit_ratio": [0.01, 0.03, 0.05, 0.07, 0.09, 0.11, 0.14, 0.18, 0.25, 0.4],
    "entropy": [2.5, 3.0, 3.25, 3.5, 3.6, 3.7, 3.8, 3.9, 4.0, 4.1, 4.2, 4.4, 4.7, 5.0],
    "params": [1, 2, 3, 5, 9],
    "host_dots": [1, 2, 3, 4, 5],
    "host_hyphens": [1, 2, 3, 5],
    "suffix1": [-2.0, -1.0, -0.5, -0.25, 0.25, 0.5, 1.0, 2.0],
    "suffix2": [-2.0, -1.0, -0.5, -0.25, 0.25, 0.5, 1.0, 2.0],
}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = text_or_empty(rest)
    before = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(before, "/", 1)
    return ascii_lower(host), F.substring(before, F.length(host) + 1, F.length(before))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need nothing but the url."""
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))) / len(x)
    # Equal characters stand together in the sorted characters; each run is one character's count.
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(F.lower(url), "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    entropy = F.aggregate(runs, F.lit(0.0), lambda a, r: a - (F.length(r) / n) * F.log2(F.length(r) / n))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substring(url, F.instr(url, "?") + 1, F.length(url)), "#", 1)).otherwise("")
    return {
        "length": F.length(url).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n,
        "entropy": F.coalesce(entropy, F.lit(0.0)),
        "params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
        "host_dots": count(host, ".").cast("double"),
        "host_hyphens": count(host, "-").cast("double"),
    }


def suffixes(host: Column) -> dict[str, Column]:
    return {"s1": F.substring_index(host, ".", -1), "s2": F.substring_index(host, ".", -2)}


@dataclass
class Model:
    """base: log-odds before any tree.  trees: nested (feature, edge, left, right) tuples with floats as leaves."""

    base: float
    trees: list
    stats: DataFrame | None = None

    def log_odds(self) -> Column:
        """Log-odds of ``block`` from the feature columns."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _as_column(tree)
        return total


def _as_column(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, edge, left, right = tree
    return F.when(F.col(feature) < F.lit(float(edge)), _as_column(left)).otherwise(_as_column(right))


def _with_features(urls: DataFrame) -> DataFrame:
    """Adds host, path, lexical features and suffixes to rows that have ``url`` (not null)."""
    host, path = host_and_path(F.col("url"))
    rows = urls.withColumns({"host": host, "path": path})
    rows = rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    return rows.withColumns(suffixes(F.col("host")))


def _with_statistics(rows: DataFrame, stats: DataFrame | None, *keys: str) -> DataFrame:
    """Adds suffix1 and suffix2; 0 where a suffix is unknown.  ``keys`` are further columns that must agree."""
    if stats is None:
        return rows.withColumns({"suffix1": F.lit(0.0), "suffix2": F.lit(0.0)})
    for k in ("1", "2"):
        own = stats.where(F.col("kind") == f"s{k}").select(*keys, F.col("suffix").alias(f"s{k}"), F.col("odds").alias(f"suffix{k}"))
        rows = rows.join(own, [*keys, f"s{k}"], "left").withColumn(f"suffix{k}", F.coalesce(F.col(f"suffix{k}"), F.lit(0.0)))
    return rows


def _suffix_odds(n: Column, block: Column) -> Column:
    return n / (n + SUFFIX_PRIOR) * F.log((block + 1.0) / (n - block + 1.0))


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def suffix_statistics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (url, label, w): (kind, suffix, odds) over all rows, and (kind, suffix, fold, odds) over the rows of all other folds."""
    counted = rows.withColumns(suffixes(host_and_path(F.col("url"))[0]) | {"fold": _fold(F.col("url"))})
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in ("s1", "s2")))).alias("p")
    by_fold = counted.select("label", "w", "fold", pairs).groupBy("p.kind", "p.suffix", "fold").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("block"))
    # A row a suffix, its folds in an array of FOLDS at most.
    stats = by_fold.groupBy("kind", "suffix").agg(F.sum("n").alias("n"), F.sum("block").alias("block"), F.collect_list(F.struct("fold", "n", "block")).alias("folds"))
    stats = materialize(stats, "url-suffixes")
    others = stats.select("kind", "suffix", "n", "block", F.explode("folds").alias("f"))
    others = others.select("kind", "suffix", F.col("f.fold").alias("fold"), _suffix_odds(F.col("n") - F.col("f.n"), F.col("block") - F.col("f.block")).alias("odds"))
    return stats.select("kind", "suffix", _suffix_odds(F.col("n"), F.col("block")).alias("odds")), others


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn from (url, label) rows, label 1 for block and 0 for allow."""
    rows = labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull()).select("url", F.col("label").cast("double").alias("label"))
    rows = materialize(rows.groupBy("url", "label").agg(F.count("*").cast("double").alias("w")), "url-labelled")
    all_rows = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("urls"), F.sum("w").alias("w")).collect()}  # two rows
    if len(all_rows) < 2:
        return Model(-1.0, [])
    stats, others = suffix_statistics(rows)
    least = {x: min(r["urls"], max(1, max_train // 2)) for x, r in all_rows.items()}
    most = {x: min(r["urls"], max(least[x], max_train - least[1.0 - x])) for x, r in all_rows.items()}
    first = [rows.where(F.col("label") == x).orderBy(F.xxhash64("url"), "url").limit(n) for x, n in most.items()]
    sample = _with_features(first[0].unionByName(first[1])).withColumn("fold", _fold(F.col("url")))
    bins = {f: sum((F.when(F.col(f) >= e, 1).otherwise(0) for e in edges), F.lit(0)).alias(f) for f, edges in EDGES.items()}
    cells = _with_statistics(sample, others, "fold").select("label", "w", *bins.values()).groupBy("label", *EDGES).agg(F.sum("w").alias("w"))
    cells = materialize(cells.coalesce(1), "url-cells")
    n = {r["label"]: r["w"] for r in cells.groupBy("label").agg(F.sum("w").alias("w")).collect()}  # two rows
    share = sum(n.values()) / sum(r["w"] for r in all_rows.values())
    n, drawn = {x: r["w"] * share for x, r in all_rows.items()}, n
    cells = cells.withColumn("w", F.col("w") * F.when(F.col("label") == 1.0, n[1.0] / drawn[1.0]).otherwise(n[0.0] / drawn[0.0]))
    base = math.log(n[1.0] / n[0.0])
    trees: list = []
    for _ in range(TREES):
        trees.append(_grow(cells, base, trees))
    return Model(base, [_edges(t) for t in trees], stats)


def _grow(cells: DataFrame, base: float, trees: list):
    """One regression tree on the gradients of the logistic loss; splits are bin numbers."""
    odds = F.lit(base)
    for t in trees:
        odds = odds + _as_column(t)
    p = 1.0 / (1.0 + F.exp(-odds))
    scored = cells.withColumns({"g": F.col("w") * (F.col("label") - p), "h": F.col("w") * p * (1.0 - p)})
    names = list(EDGES)
    splits: dict[int, tuple[str, int]] = {}  # node to (feature, first bin of the right side); children of i are 2i+1, 2i+2
    values: dict[int, float] = {}
    live = [0]
    for depth in range(DEPTH + 1):
        node = _node(splits)
        long = scored.select(node.alias("node"), "g", "h", F.posexplode(F.array(*names)).alias("f", "bin"))
        sums = long.where(F.col("node").isin(live)).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        here, live = live, []
        for i in here:
            own = [r for r in sums if r["node"] == i]
            g, h = (math.fsum(r[k] for r in own if r["f"] == 0) for k in ("g", "h"))
            values[i] = RATE * g / (h + LAMBDA)
            best = (1e-6, None)
            for f in range(len(names)) if depth < DEPTH else ():
                left_g = left_h = 0.0
                for r in sorted((r for r in own if r["f"] == f), key=lambda r: r["bin"]):
                    if left_h > 0:
                        gain = left_g**2 / (left_h + LAMBDA) + (g - left_g) ** 2 / (h - left_h + LAMBDA) - g**2 / (h + LAMBDA)
                        best = max(best, (gain, (names[f], r["bin"])), key=lambda x: x[0])
                    left_g, left_h = left_g + r["g"], left_h + r["h"]
            if best[1]:
                splits[i] = best[1]
                live += [2 * i + 1, 2 * i + 2]
        if not live:
            break
    return _tree(0, splits, values)


def _node(splits: dict[int, tuple[str, int]], i: int = 0) -> Column:
    if i not in splits:
        return F.lit(i)
    f, b = splits[i]
    return F.when(F.col(f) < b, _node(splits, 2 * i + 1)).otherwise(_node(splits, 2 * i + 2))


def _tree(i: int, splits: dict, values: dict):
    return (*splits[i], _tree(2 * i + 1, splits, values), _tree(2 * i + 2, splits, values)) if i in splits else values[i]


def _edges(tree):
    """Bin numbers to the features' own values."""
    if isinstance(tree, float):
        return tree
    feature, b, left, right = tree
    return feature, EDGES[feature][b - 1], _edges(left), _edges(right)


def judge(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``id_col``, host, path, rule, verdict and block_score (the model's probability of block) for each row."""
    rows = _with_features(pages.select(F.col(id_col), text_or_empty(F.col(url_col)).alias("url")))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    scored = _with_statistics(rows, model.stats).withColumn("block_score", 1.0 / (1.0 + F.exp(-model.log_odds())))
    by_model = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "block_score")


def labels_from_rules(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """(url, label) of the urls that a curated rule decides."""
    rows = pages.select(text_or_empty(F.col(url_col)).alias("url"))
    _, verdict = rule_and_verdict(*host_and_path(F.col("url")), rules)
    return rows.withColumn("label", F.when(verdict == "block", 1).when(verdict == "allow", 0)).where(F.col("label").isNotNull())


def auc(scored: DataFrame, score: str = "block_score", label: str = "label") -> float | None:
    """The share of (block, allow) pairs of rows that ``score`` puts in order, ties half; null without both labels.

    Rows are summed by score, and scores by leaf are few: a model has at most 8 ** ``TREES`` of them, whatever the input."""
    from pyspark.sql import Window

    at = scored.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("double")).alias("b"), F.sum((F.col(label) == 0).cast("double")).alias("a"))
    below = F.sum("a").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    r = at.withColumn("below", F.coalesce(below, F.lit(0.0))).agg(F.sum(F.col("b") * (F.col("below") + F.col("a") / 2)).alias("x"), F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    return r["x"] / (r["b"] * r["a"]) if r["b"] and r["a"] else None


def held_out_auc(pages: DataFrame, url_col: str = "url", rules=RULES) -> dict[str, float | None]:
    """How well urls are ranked that a model has not learned from.

    ``urls``: a fifth of the labelled urls (by hash) is left out.  A pair of a blocking and an allowing rule, as in ``net/ example.net/en/``: the
    model learns from what all other rules say and ranks what this pair decides, so it cannot just repeat them."""
    named = pages.select(F.monotonically_increasing_id().alias("page_id"), text_or_empty(F.col(url_col)).alias("url"))
    rule, verdict = rule_and_verdict(*host_and_path(F.col("url")), rules)
    rows = materialize(named.withColumns({"rule": rule, "label": F.when(verdict == "block", 1).when(verdict == "allow", 0)}).where(F.col("label").isNotNull()), "url-rules")
    tests = {"urls": F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(5)) == 0}
    for block in (h + p for h, p, v in rules if v == "block"):
        tests |= {f"{block} {allow}": F.col("rule").isin(block, allow) for allow in (h + p for h, p, v in rules if v == "allow")}
    out = {}
    for name, held in tests.items():
        model = fit(rows.where(~held).select("url", "label"))
        out[name] = auc(judge(rows.where(held), model).join(rows.select("page_id", "label"), "page_id"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: verdict on every page's url; the labelled urls are those that the rules decide."""
    from corpusloom.llm.common import table

    pages = table(spark, sf_dir, "pages")
    return judge(pages, fit(labels_from_rules(pages)))
