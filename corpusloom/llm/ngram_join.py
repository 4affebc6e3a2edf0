"""Operator 3: n-gram Jaccard join by token-combination prefixes.

A text's tokens are its distinct five-word shingles.  Tokens are ordered by the number of texts that hold them, rarest
first, counted over all texts.  Two sets of Jaccard similarity 0.8 share at least k tokens of their prefixes of length
n - ceil(0.8 n) + k, the k that come first in this order.  A token that at most ``RARE`` texts hold is rare, else frequent.

* If the first token that two sets share is rare, it is in both prefixes for k = 1: each set is indexed under every rare token
  of that prefix, alone.
* Else all tokens that they share are frequent.  Frequent tokens are dealt to g classes by their hash, and prefixes are extended
  to k = g + 1: two of the shared tokens there have one class.  Each set is indexed under every combination of two frequent
  tokens of one class of that prefix.

g is a power of two between a tenth and a fifth of n (at least 1), so a set of any size has about n / 2 combinations.  A set
whose similar sets can have the g below its own is indexed with both.  Tokens that one text holds are never indexed, but take
up their places in the prefix, and combinations are made only of a set that has at least 0.8 n frequent tokens, so most
texts have no entry at all.

An entry also says how many tokens its set can share with one that it meets there first; sets that cannot reach 0.8 with any
member of a list leave it.  What meets is verified on the whole token sets, exactly
but for collisions of the tokens' 64-bit hashes.  A list is not expanded into all pairs: every member is compared with the
list's most central member first, components are joined, and only lists that still hold two components go on, with 8, 64,
512 ... further pivots, between members of different components whose distances to the first pivot allow a link by the
triangle inequality.  The last round has every member as a pivot, so nothing is left out; copies cost one comparison each.
Members also carry 256 parities of their tokens' hashes: two sets differ by at least as many tokens as parities, so pairs that differ by
more than a ninth of their sizes together, which is what 0.8 allows, are not formed.
A list of more than ``PART`` members is dealt in parts by a hash of the member; every part meets all pivots of a round.

Texts with equal sets are one node from the start.  See ``blocks`` for how counts are made.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and are their own component; a
text of one to four words has its whole sequence as its only shingle; repeated rows are members of the same component;
component ids are the smallest non-null id of a component, null if it has none; an empty table gives an empty table; other
columns are ignored by ``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.blocks import block_count, distinct_texts, lookup, lookup_table, text_key, totals
from corpusloom.llm.common import arrow_texts, enter, free_shuffles, groups_by_bytes, has_rows, materialize
from corpusloom.llm.graph import components, extend
from corpusloom.llm.textvec import SPACED, mix, shingles, word_hashes

U = np.uint64
SHINGLE = 5
RARE = 32
PIVOTS = 8
#: Members of a list that are compared with its pivots in one task; longer lists are dealt in parts.
PART = 256
STEP = 1 << 20
KEY, LEAST, CHOSEN = "_text_key_", "_least_id_", "_chosen_"


def _sets(table) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(row numbers, token sets) of a block's texts, each distinct text once."""
    keys = table.column("key").to_pylist()
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    at = sorted(first.values())
    texts = arrow_texts(table.column("text").take(at).combine_chunks()) if len(at) else []
    for a, b in groups_by_bytes(texts, STEP):
        yield at[a:b], shingles(*word_hashes(texts[a:b], SPACED), SHINGLE)


def _block_tokens(table) -> tuple[np.ndarray, np.ndarray]:
    sets = [s for _, part in _sets(table) for s in part]
    return np.unique(np.concatenate([np.zeros(0, U), *sets]), return_counts=True)


def classes(n: int) -> int:
    """Classes of frequent tokens for a set of ``n`` tokens: the power of two between n / 10 and n / 5, at least 1."""
    return 1 << max(0, (n // 5).bit_length() - 1)


def parities(tokens: np.ndarray) -> np.ndarray:
    """Four 64-bit numbers: for each of 256 classes of tokens, whether the set holds an odd number of them."""
    odd = np.bincount((mix(tokens ^ U(0x2545F4914F6CDD1D)) & U(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _combinations(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all pairs of equal values."""
    order = np.argsort(group, kind="stable")
    start = np.searchsorted(group[order], group[order])
    before = np.arange(len(group)) - start
    i = np.arange(before.sum()) - np.repeat(np.cumsum(before) - before - start, before)
    return order[i], order[np.repeat(np.arange(len(group)), before)]


def index_keys(tokens: np.ndarray, held: np.ndarray, n: int, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the lists that a set of ``n`` tokens stands in, most tokens it can share with a set that it meets there first).

    ``tokens``: those that other texts hold too; ``held``: by how many.  The bound counts the key's last token, all that come
    after it in the order, and the tokens before it that can be shared without a combination: one of each class."""
    needed = -(-80 * n // 100)
    if len(tokens) < needed:
        return np.zeros(0, U), np.zeros(0, np.int64)
    order = np.lexsort((tokens, held))
    tokens, few, rest = tokens[order], held[order] <= rare, len(tokens) - np.arange(len(tokens))
    single = few & (rest >= needed)
    keys, bounds = [mix(tokens[single] ^ U(0x5851F42D4C957F2D))], [rest[single]]
    frequent, after = tokens[~few], rest[~few]
    for g in {classes(n), classes(needed)} if len(frequent) >= needed else ():
        prefix = frequent[after + g >= needed]
        i, j = _combinations(mix(prefix) & U(g - 1))
        most = after[j] + np.minimum(g, j)
        i, j, most = (x[most >= needed] for x in (i, j, most))
        pair = np.minimum(prefix[i], prefix[j]) * U(0xD1342543DE82EF95) + mix(np.maximum(prefix[i], prefix[j]))
        keys.append(mix(pair + U(g)))
        bounds.append(most)
    unique, first = np.unique(np.concatenate(keys), return_index=True)
    return unique, np.concatenate(bounds)[first]


def token_sets(docs: DataFrame, text_col: str = "text", rare: int = RARE) -> DataFrame:
    """One row for each distinct text that has words: key, node (digest of its set), n long, alone long (tokens that no other
    text holds), tokens binary (the others; null if it stands in no list), bits array<long> (their parities, likewise), keys array<struct<key long, most int>>."""
    import pyarrow as pa

    blocks = block_count(docs, text_col)
    dealt = distinct_texts(docs, text_col, blocks)

    def attach(table: pa.Table, counts: pa.Table) -> pa.Table:
        enter("blocks")
        x, held = lookup_table(counts)
        names = table.column("key").to_pylist() if table.num_rows else []
        found, bounds = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        cols: dict[str, list] = {"key": [], "node": [], "n": [], "alone": [], "tokens": [], "bits": [], "keys": []}
        for rows, sets in _sets(table) if table.num_rows else ():
            sizes = [len(s) for s in sets]
            number = lookup(np.concatenate(sets), x, held)
            at = 0
            for row, s, n in zip(rows, sets, sizes, strict=True):
                h = number[at : at + n]
                at += n
                if not n:
                    continue
                shared = h > 1
                keys, most = index_keys(s[shared], h[shared], n, rare)
                row_values = (names[row], hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), n, n - int(shared.sum()), s[shared].astype("<u8").tobytes() if len(keys) else None, parities(s[shared]).tolist() if len(keys) else None, len(keys))
                for c, v in zip(cols, row_values, strict=True):
                    cols[c].append(v)
                found.append(keys)
                bounds.append(most)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(bounds).astype(np.int32))], ["key", "most"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *cols.pop("keys")]), pa.int32()), flat)
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([*(pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)), lists], [*cols, "keys"])

    back = totals(dealt, blocks, _block_tokens, least=2)
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(attach, "key string, node string, n bigint, alone bigint, tokens binary, bits array<bigint>, keys array<struct<key:bigint,most:int>>")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared long, union long) for pairs of nodes, exactly, from their token sets (node, n, tokens)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ngram_join")
        for batch in batches:
            na, nb = (np.asarray(batch.column(k)) for k in (2, 3))
            shared = np.array([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(na + nb - shared)], ["a", "b", "shared", "union"])

    one, two = (sets.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("tokens").alias("t" + c)) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(run, "a string, b string, shared bigint, union bigint")


def _linked():
    return 100 * F.col("shared") >= 80 * F.col("union")


def _needed(n, other):
    """Tokens that sets of these sizes must share, times 180."""
    return 80 * (n + other)


def link_components(texts: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes that are linked with another, from what ``token_sets`` returns; None if there are none."""
    indexed = texts.where(F.size("keys") > 0).dropDuplicates(["node"])
    sets = materialize(indexed.select("node", "n", "tokens", (F.col("alone") / F.col("n")).alias("apart"), "bits", "keys"), "token-sets")
    entries = possible(sets.select("node", "n", "apart", F.explode("keys").alias("k")).select("node", "n", "apart", "k.key", "k.most"))
    lists = entries.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct(F.round("apart", 2), -F.col("n"), "node")).alias("first")).where("members > 1")
    lists = materialize(lists.select("key", "members", F.col("first.node").alias("pivot")), "lists")
    if not has_rows(lists):
        return None
    entries = materialize(in_parts(entries.drop("apart").join(lists, "key")), "entries")
    pairs = entries.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    checked = materialize(verify(pairs, sets), "verified")
    labels = components(checked.where(_linked()))
    distance = 1.0 - F.col("shared") / F.col("union")
    apart = checked.select(F.col("a").alias("node"), F.col("b").alias("pivot"), distance.alias("d"))
    left = open_lists(entries.join(apart, ["node", "pivot"], "left").withColumn("d", F.coalesce("d", F.lit(0.0))), labels)
    left = materialize(left.join(sets.select("node", "bits"), "node"), "open-lists")
    done, level = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), 0
    most = left.agg(F.max("members")).first()[0]
    while most is not None:
        # A member becomes a pivot at a level that follows from a hash of it: about 8 members at level 0, 64 at 1 ...
        turn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30) * F.col("members")
        turn = F.floor(F.log(F.greatest(turn, F.lit(1.0))) / F.log(F.lit(float(PIVOTS)))).cast("int")
        members = left.withColumn("turn", turn).where(F.col("turn") >= level)
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        q = members.where(F.col("turn") == level).select("key", every, *(F.col(c).alias("q_" + c) for c in ("node", "n", "most", "d", "root", "bits")))
        met = members.join(q, ["key", "part"]).where(
            (F.col("root") != F.col("q_root"))
            & ((F.col("turn") > level) | (F.col("node") < F.col("q_node")))
            & (100 * F.least("n", "q_n") >= 80 * F.greatest("n", "q_n"))
            & (180 * F.least("most", "q_most") >= _needed(F.col("n"), F.col("q_n")))
            & (F.abs(F.col("d") - F.col("q_d")) <= 0.2 + 1e-9)
            & (9 * _differing("bits", "q_bits") <= F.col("n") + F.col("q_n"))
        )
        new = met.select(F.least("node", "q_node").alias("a"), F.greatest("node", "q_node").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
        found = materialize(verify(new, sets), "verified")
        done = done.unionByName(found.select("a", "b"))
        linked = found.where(_linked()).select("a", "b")
        if has_rows(linked):
            # Contract to the components so far, so that their roots go on to one root.
            if labels is not None:
                a, b = (labels.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
                linked = linked.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            labels = extend(labels, components(linked))
            left = open_lists(left.drop("root"), labels)
        level += 1
        if PIVOTS**level > most:
            break
    return labels


def _differing(a: str, b: str):
    """Parities in which two sets differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, 4)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def possible(entries: DataFrame) -> DataFrame:
    """The entries of lists with at least two members, without those that cannot share enough with a set of the list's least size,
    or of the least size that can be similar."""
    least = entries.groupBy("key").agg(F.min("n").alias("_n"), F.count("*").alias("_c")).where("_c > 1")
    enough = 180 * F.col("most") >= F.greatest(_needed(F.col("n"), F.col("_n")), 144 * F.col("n"))
    return entries.join(least, "key").where(enough).drop("_n", "_c")


def in_parts(entries: DataFrame) -> DataFrame:
    """Adds parts int, of a list by its members, and part int, of an entry by its node."""
    rows = entries.withColumn("parts", F.ceil(F.col("members") / PART).cast("int"))
    return rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))


def open_lists(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The entries, with their root, of lists that still hold more than one component and may hold a link between two."""
    named = entries.withColumn("root", F.col("node")) if labels is None else entries.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("parts").alias("parts")).where("lo != hi")
    mixed = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return materialize(named.join(mixed, ["key", "part"], "left_semi"), "open-lists")


def _classes(docs: DataFrame, id_col: str, text_col: str, rare: int) -> DataFrame:
    """For each distinct text with words: _key, n_shingles, root (of its component), least (smallest id of its rows)."""
    texts = materialize(token_sets(docs, text_col, rare), "texts")
    free_shuffles(docs.sparkSession)
    labels = link_components(texts)
    rows = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"))
    least = rows.groupBy("_key").agg(F.min("_id").alias("least"))
    named = texts.select(F.col("key").alias("_key"), "node", F.col("n").alias("n_shingles")).join(least, "_key")
    return named.withColumn("root", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """``id_col``, n_shingles long and component_id (smallest id reachable by links) for each row."""
    named = _classes(docs, id_col, text_col, rare)
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(tops, "root").select("_key", "n_shingles", "component_id"), "components")
    rows = docs.select(F.col(id_col), text_key(F.col(text_col)).alias("_key"))
    joined = rows.join(named.withColumn("_there", F.lit(True)), "_key", "left")
    own = F.when(F.col("_there"), F.col("component_id")).otherwise(F.col(id_col))
    return joined.select(id_col, F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps one: that with its smallest id (null last), one of them
    if rows repeat.  Rows without words all stay."""
    named = _classes(docs, id_col, text_col, rare)
    named = materialize(named.select("_key", "root", "least"), "components")
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "_key")).alias("c"))
    marks = named.select("_key", "least", "root").join(chosen, "root")
    marks = materialize(marks.select(F.col("_key").alias(KEY), F.col("least").alias(LEAST), (F.col("c._key") == F.col("_key")).alias(CHOSEN)), "chosen")
    free_shuffles(docs.sparkSession)
    keyed = docs.withColumn(KEY, text_key(F.col(text_col)))
    joined = keyed.join(marks, KEY, "left")
    worded, mine = F.col(CHOSEN).isNotNull(), F.col(CHOSEN) & F.col(id_col).eqNullSafe(F.col(LEAST))
    kept = joined.where(~worded | mine)
    ids = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"))
    if has_rows(ids.groupBy("_key", "_id").count().where("count > 1").join(named, "_key", "left_semi")):
        # Some worded row stands there twice: a second pass, only for such inputs.
        kept = kept.where(~worded).unionByName(kept.where(worded).dropDuplicates([KEY]))
    return kept.drop(KEY, LEAST, CHOSEN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: near-duplicate components of all whole documents."""
    from corpusloom.llm.common import table

    return join(table(spark, sf_dir, "documents"))
