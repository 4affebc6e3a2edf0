from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import urls

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.net/x?y=1#z", "https://x.example.net/en/1", "https://example.net/en", "http://notexample.net/en/",
    "http://example.com/de/9#f", "http://m.example.com/DE/9", "ftp://u.org/fr/a://b", "http://org/fr/", "http://evil.org?x=/fr/", "http://a.b#c/d?e", "x://É.NET/ü/1?a=1&b=2&c", "://", "http://-.com/" + "9" * 5000,
]


def cut(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_host_path_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "?") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = urls.judge(pages, urls.Model(-1.0, [])).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = cut((URLS * 2)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_lexical_features(spark):
    df = spark.createDataFrame([(u,) for u in URLS if u], "url string")
    host, path = urls.host_and_path(F.col("url"))
    rows = df.withColumns({"host": host, "path": path})
    for r in rows.withColumns(urls.lexical(F.col("url"), F.col("host"), F.col("path"))).collect():
        u = r["url"]
        n = Counter(u.lower())
        assert math.isclose(r["entropy"], -sum(c / len(u) * math.log2(c / len(u)) for c in n.values()), abs_tol=1e-9)
        assert r["length"] == len(u) and math.isclose(r["digit_ratio"], sum(c.isascii() and c.isdigit() for c in u) / len(u))
        assert r["depth"] == len([p for p in r["path"].split("/") if p])


def test_trees_learn(spark):
    """Long urls with many digits are blocked; the model must find out."""
    rows = [(f"http://site{i % 7}.com/{'1' * (30 + i % 9)}", 1) if i % 2 else (f"http://site{i % 7}.com/about/us{'x' * (i % 9)}", 0) for i in range(300)]
    model = urls.fit(spark.createDataFrame(rows, "url string, label int"))
    pages = spark.createDataFrame([(1, "http://other.com/99999999999999999999999999999999"), (2, "http://other.com/about/team")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, model, rules=()).collect()} == {1: "block", 2: "allow"}


def test_one_kind_of_label_or_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    model = urls.fit(urls.labels_from_rules(empty))
    assert model.trees == [] and urls.judge(empty, model).count() == 0


def test_plan_is_native(spark, tiny):
    df = urls.query(spark, tiny)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|RDD", plan)
    got = df.collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = cut(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("block", "allow") and verdict in (None, r["verdict"])


def test_hot_url_does_not_fill_the_sample(spark):
    """A url that alone has more rows than the sample has places, with a hash below all others."""
    rows = [(f"http://site{i % 7}.com/{'1' * (30 + i % 9)}{i}", 1) if i % 2 else (f"http://site{i % 7}.com/about/us{'x' * (i % 9)}/{i}", 0) for i in range(100)]
    made = [(f"http://hot.com/about/{i}", 0) for i in range(2000)]
    hashes = spark.createDataFrame(made + rows, "url string, label int").select("url", "label", F.xxhash64("url").alias("h")).orderBy("h").collect()
    hot = next(r["url"] for r in hashes if r["url"].startswith("http://hot.com"))
    model = urls.fit(spark.createDataFrame([(hot, 0)] * 60 + rows, "url string, label int"), 40)
    pages = spark.createDataFrame([(1, "http://other.com/99999999999999999999999999999999"), (2, "http://other.com/about/team")], "page_id long, url string")
    assert model.trees and {r["page_id"]: r["verdict"] for r in urls.judge(pages, model, rules=()).collect()} == {1: "block", 2: "allow"}


def test_suffixes_are_counted_over_all_labelled_rows(spark):
    rows = [(f"http://a{i}.{'bad' if i % 2 else 'good'}/x/{i}", i % 2) for i in range(400)]
    model = urls.fit(spark.createDataFrame(rows, "url string, label int"), 10)
    assert {r["suffix"] for r in model.stats.where("kind = 's1'").collect()} == {"bad", "good"}


def _boosted(rows):
    """Block scores of the urls of (url, label) rows by boosting row by row, each split tried over all rows."""
    spark_free = [(u, float(y), f) for u, y, f in rows]
    names = list(urls.EDGES)
    bins = [[sum(f[n] >= e for e in urls.EDGES[n]) for n in names] for _, _, f in spark_free]
    y = [r[1] for r in spark_free]
    odds = [math.log(sum(y) / (len(y) - sum(y)))] * len(y)

    def score(g, h):
        return g * g / (h + urls.LAMBDA)

    def grow(members, depth, g, h):
        total_g, total_h = math.fsum(g[i] for i in members), math.fsum(h[i] for i in members)
        best = (1e-6, None)
        for k in range(len(names)) if depth < urls.DEPTH else ():
            for b in sorted({bins[i][k] for i in members})[1:]:
                left = [i for i in members if bins[i][k] < b]
                lg, lh = math.fsum(g[i] for i in left), math.fsum(h[i] for i in left)
                gain = score(lg, lh) + score(total_g - lg, total_h - lh) - score(total_g, total_h)
                if gain > best[0] + 1e-9:
                    best = (gain, (k, b))
        if best[1] is None:
            return {i: urls.RATE * total_g / (total_h + urls.LAMBDA) for i in members}
        k, b = best[1]
        return grow([i for i in members if bins[i][k] < b], depth + 1, g, h) | grow([i for i in members if bins[i][k] >= b], depth + 1, g, h)

    for _ in range(urls.TREES):
        p = [1 / (1 + math.exp(-o)) for o in odds]
        step = grow(list(range(len(y))), 0, [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p])
        odds = [o + step[i] for i, o in enumerate(odds)]
    return odds


def test_statistics_leave_out_the_own_fold(spark):
    rows = spark.createDataFrame([(f"http://a{i}.{'bad' if i % 3 else 'good'}/x/{i}", float(i % 3 > 0), 1.0 + i % 2) for i in range(200)] + [("http://one.rare/", 1.0, 5.0)], "url string, label double, w double")
    stats, others = urls.suffix_statistics(rows)
    held = [(r["url"].split("/")[2].split(".")[-1], r["label"], r["w"], r["f"]) for r in rows.withColumn("f", urls._fold(F.col("url"))).collect()]

    def odds(own):
        n, block = sum(w for _, _, w, _ in own), sum(w * y for _, y, w, _ in own)
        return n / (n + urls.SUFFIX_PRIOR) * math.log((block + 1) / (n - block + 1))

    for r in stats.where("kind = 's1'").collect():
        assert math.isclose(r["odds"], odds([x for x in held if x[0] == r["suffix"]]), abs_tol=1e-9)
    found = {(r["suffix"], r["fold"]): r["odds"] for r in others.where("kind = 's1'").collect()}
    assert set(found) == {(x[0], x[3]) for x in held}
    for (suffix, fold), value in found.items():
        assert math.isclose(value, odds([x for x in held if x[0] == suffix and x[3] != fold]), abs_tol=1e-9)
    assert [v for (s, _), v in found.items() if s == "rare"] == [0.0]


def test_trees_equal_boosting_row_by_row(spark):
    """Log-odds of the learned rows, from the features with the statistics of the other folds."""
    made = [(f"http://s{i * 7 % 23}.{('aa', 'bb', 'cc')[i * 5 % 3]}/{'p/' * (i * 11 % 4)}{'9' * (i * 13 % 17)}?{'k=1&' * (i % 3)}", int(i * 29 % 31 % 7 < 3)) for i in range(240)]
    made = sorted(dict(made).items())
    df = spark.createDataFrame(made, "url string, label int")
    model = urls.fit(df)
    rows = urls._with_features(df.select("url", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("w"))).withColumn("fold", urls._fold(F.col("url")))
    rows = urls._with_statistics(rows, urls.suffix_statistics(rows.select("url", "label", "w"))[1], "fold").withColumn("odds", model.log_odds()).collect()
    want = _boosted([(r["url"], r["label"], r.asDict()) for r in rows])
    assert len(model.trees) == urls.TREES and len(set(round(w, 6) for w in want)) > 8
    assert all(math.isclose(r["odds"], w, abs_tol=1e-6) for r, w in zip(rows, want, strict=True))


def test_auc(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.9, 0), (0.9, 1)]
    want = sum((a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y) / 9
    assert math.isclose(urls.auc(spark.createDataFrame(rows, "block_score double, label int")), want)
    assert urls.auc(spark.createDataFrame(rows[:1], "block_score double, label int")) is None


def test_urls_left_out_are_ranked(spark):
    """Digits of the path give the label away.  Without the one pair of rules that occurs nothing is learned, so all scores tie."""
    rows = [(f"http://h{i % 50}.{'net' if i % 2 else 'org'}/{'fr/' if i % 2 == 0 else ''}{i}{'7' * (20 * (i % 2))}",) for i in range(300)]
    found = urls.held_out_auc(spark.createDataFrame(rows, "url string"))
    assert found["urls"] > 0.99 and found["net/ org/fr/"] == 0.5
