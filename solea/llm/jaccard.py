"""N-gram Jaccard join by prefix filters under several global orders.

A text's set holds its distinct word shingles as 64-bit hashes. Two sets of similarity t or more share a token among the first
n - ceil(t n) + 1 tokens of each under any one order of all tokens. Three orders are used. Under the first, tokens whose
hash falls in a fixed share of the range come first, rarest first by their exact document counts over all documents; its
prefixes form the index. The other two are independent hash orders; a candidate must also share a prefix token under both, and
only then are whole sets fetched and compared exactly.

Every set also carries a parity sketch: 512 bits, each the parity of the number of its tokens that fall there. Two sketches differ in at most
as many bits as their sets differ in tokens, so a pair whose sketches are too far apart is dropped inside the join, and no true pair is.

Equal sets form one class and only class representatives go on. Links are looked for component by component: in each index list
every member is compared with one hub, verified links join members to groups that are surely connected, and only pairs across such groups remain
for the last, exhaustive step: within a list, members outside its largest group against all others. So a list of thousands of near copies costs about as
many comparisons as it has members, and no pair that could join two components is left out. The last step leaves a pair out of a list if an earlier list
has both: each member carries the first ``EARLY`` tokens of its prefix, and two that share one of them before the list's own token met there.

Defined cases: null or wordless texts have no shingles and link with nothing; fewer words than a shingle form one token; repeated rows share a class;
an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solea.llm.batches import slices
from solea.llm.components import connected_components
from solea.session import release, store

BROADCAST_ROWS = 1_000_000  # keys of a side that may be broadcast after counting; beyond it the join is shuffled
HUB_ROUNDS = 2
EARLY = 8  # first prefix tokens that the last step carries, to compare a pair once and not in each of its lists
SKETCH = [f"s{i}" for i in range(8)]
_M = np.uint64(0x9E3779B97F4A7C15)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z lowered, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b"\n".join(words), seed=len(words))] if words else [], np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = len(words) - width + 1
    mixed = word[:count].copy()
    for i in range(1, width):
        mixed = mixed * _M + word[i : i + count]
    return np.unique(_scatter(mixed))


def leading_share(percent: int) -> float:
    """Share of the hash range whose tokens lead the first order: a little more than a prefix's share of its set."""
    return 1.25 * (100 - percent) / 100 + 0.02


def prefix_size(n: int, percent: int) -> int:
    """How many leading tokens of a set of n must meet those of any set of at least that similarity."""
    return n + percent * n // -100 + 1 if n else 0


def hash_order_prefix(tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens under one of the hash orders, shortened to 32 bits (shortening can only add candidates)."""
    ranked = _scatter(tokens ^ np.uint64(0xD6E8FEB86659FD93 * order & (1 << 64) - 1))
    size = prefix_size(len(tokens), percent)
    first = np.partition(ranked, size - 1)[:size] if 0 < size < len(ranked) else ranked
    return (first >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """512 parities as eight 64-bit integers."""
    odd = np.bincount((tokens & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches_fit(other: str, n: str, m: str, percent: int):
    """Whether two sketches (the other one's columns have a prefix) allow the similarity."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(other + c))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(other + SKETCH[0]))))
    return differ * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent)


def _digests(documents: DataFrame, width: int) -> DataFrame:
    @F.pandas_udf("n long, set_key binary")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in slices(batches):
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes())) for s in (shingle_set(t, width) for t in texts)]
            yield pd.DataFrame(rows, columns=["n", "set_key"])

    return documents.select("doc_id", digest("text").alias("d")).select("doc_id", "d.n", "d.set_key")


def _class_nodes(every: DataFrame) -> DataFrame:
    """(set_key, doc_id, node): one row for each set, with its smallest document and a 64-bit name that no other set has."""
    classes = every.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    for salt in range(100):
        named = classes.withColumn("node", F.xxhash64("set_key", F.lit(salt)))
        if named.groupBy("node").count().where("count > 1").isEmpty():
            return named
    raise ValueError("no names without collisions")


def _keyed_texts(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, set_key, text) for wanted (doc_id, node, set_key) rows; the keys are broadcast only when counted as few.

    Documents that share an id are told apart later by the key of their set.
    """
    small = keys.count() <= BROADCAST_ROWS
    return documents.select("doc_id", "text").join(F.broadcast(keys) if small else keys, "doc_id").select("node", "set_key", "text")


def _index_tokens(texts: DataFrame, width: int, percent: int, lead: float) -> DataFrame:
    """(node, n, lead, extra, sketch): tokens of the leading share, and the further ones that a short set needs to fill its prefix."""

    @F.pandas_udf("n long, lead array<long>, extra array<long>, " + ", ".join(f"{c} long" for c in SKETCH) + ", own_key binary")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        limit = np.uint64(min(int(lead * 2**64), 2**64 - 1))
        for batch in slices(batches):
            rows = []
            for text in batch:
                s = shingle_set(text, width)
                cut = int(np.searchsorted(s, limit))
                rows.append((len(s), s[:cut].view(np.int64), s[cut : max(cut, prefix_size(len(s), percent))].view(np.int64), *parity_sketch(s), xxhash.xxh3_128_digest(s.tobytes())))
            yield pd.DataFrame(rows, columns=["n", "lead", "extra", *SKETCH, "own_key"])

    # as a non-deterministic step it runs once, not again for the filter on its result
    found = texts.select("node", "set_key", tokens.asNondeterministic()("text").alias("t")).select("node", "set_key", "t.*")
    return found.where("set_key = own_key").drop("set_key", "own_key")


def _prefix_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, place): the prefixes under the first order, without tokens that only one set has."""
    lead = sets.select("node", F.explode("lead").alias("token"), F.lit(None).cast("int").alias("fixed"))
    extra = sets.where(F.size("extra") > 0).select("node", F.size("lead").alias("leading"), F.posexplode("extra").alias("i", "token"))
    rows = lead.union(extra.select("node", "token", (F.col("leading") + F.col("i")).alias("fixed")))
    shared = rows.groupBy("token").agg(F.count("*").alias("documents")).where("documents > 1")
    found = rows.join(shared, "token").join(sets.select("node", "n", F.size("lead").alias("leading")), "node")
    own = Window.partitionBy("node")
    ranked = found.withColumn("rank", F.row_number().over(own.orderBy(F.col("fixed").asc_nulls_first(), "documents", "token"))).withColumn(
        "met", F.count(F.when(F.col("fixed").isNull(), 1)).over(own))
    place = F.coalesce("fixed", F.col("leading") - F.col("met") + F.col("rank") - 1)
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.withColumn("place", place).where(F.col("place") < size).select("token", "node", "place")


def _whole_sets(texts: DataFrame, width: int, percent: int) -> DataFrame:
    @F.pandas_udf("tokens array<long>, second array<int>, third array<int>, own_key binary")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            sets = [shingle_set(t, width) for t in batch]
            yield pd.DataFrame({
                "tokens": [s.view(np.int64) for s in sets],
                "second": [hash_order_prefix(s, 2, percent) for s in sets],
                "third": [hash_order_prefix(s, 3, percent) for s in sets],
                "own_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            })

    found = texts.select("node", "set_key", whole.asNondeterministic()("text").alias("w")).select("node", "set_key", "w.*")
    return found.where("set_key = own_key").drop("set_key", "own_key")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the other two orders and whose whole sets are similar enough."""

    def side(name: str, columns: list[str]) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    orders = ["second", "third"]
    passed = pairs.join(side("a", orders), "a").join(side("b", orders), "b")
    for order in orders:
        passed = passed.where(F.arrays_overlap(f"{order}_a", f"{order}_b"))

    whole = passed.select("a", "b").join(side("a", ["tokens"]), "a").join(side("b", ["tokens"]), "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return whole.where(100 * common >= percent * (F.size("tokens_a") + F.size("tokens_b") - common)).select("a", "b")


def _early_tokens(lists: DataFrame) -> DataFrame:
    """(node, early): the first tokens of each prefix with their places, at most ``EARLY``; other nodes' lists are not touched."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy("place", "token"))
    first = lists.select("node", "place", "token", rank.alias("rank")).where(F.col("rank") <= EARLY)
    return first.groupBy("node").agg(F.collect_list(F.struct("place", "token")).alias("early"))


def _hub_labels(links: DataFrame) -> DataFrame:
    """(node, label): of a node and its neighbours the one with most links. Nodes of equal label are connected; more is not needed midway."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    degree = both.groupBy("node").agg(F.count("*").alias("degree"))
    near = both.join(degree.withColumnRenamed("node", "other"), "other").select("node", F.struct("degree", "other").alias("d"))
    own = degree.select("node", F.struct("degree", F.col("node").alias("other")).alias("d"))
    return near.union(own).groupBy("node").agg(F.max("d").alias("d")).select("node", F.col("d.other").alias("label"))


def _sizes_fit(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()


def similar_classes(documents: DataFrame, width: int = 5, percent: int = 80, lead: float | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    Links join documents with 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles. ``lead`` is the share of the hash range
    whose tokens are counted and lead the first order (``leading_share`` unless given): a larger one costs more counting, and its prefixes hold rarer tokens, so that
    lists are shorter and fewer pairs are compared. It changes no result.
    """
    lead = leading_share(percent) if lead is None else lead
    spark = documents.sparkSession
    every, every_path = store(_digests(documents, width), "shingle-digests")
    classes, classes_path = store(_class_nodes(every), "classes")
    tokens, tokens_path = store(_index_tokens(_keyed_texts(documents, classes), width, percent, lead), "shingles")
    prefixes, prefixes_path = store(_prefix_lists(tokens, percent), "prefixes")
    shared = prefixes.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    lists, lists_path = store(prefixes.join(shared, "token").join(tokens.select("node", "n", *SKETCH), "node").distinct(), "lists")
    release(spark, prefixes_path, tokens_path)

    links = spark.createDataFrame([], "a long, b long")
    tried = links
    labels = spark.createDataFrame([], "node long, label long")
    paths: list[str] = [lists_path]
    for step in range(HUB_ROUNDS + 1):
        labelled = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        if step < HUB_ROUNDS:
            # first the member with the fewest tokens of its own, which is most like the others; then any
            first = F.when(F.lit(step == 0), F.col("place")).otherwise(F.lit(0))
            chosen = F.min(F.struct(first.alias("first"), F.xxhash64("node", F.lit(step)).alias("h"), "node", "n", "label", *SKETCH)).alias("hub")
            hubs = labelled.groupBy("token").agg(chosen).select(
                "token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.label").alias("hub_label"), *[F.col(f"hub.{c}").alias(f"o_{c}") for c in SKETCH])
            pairs = labelled.join(hubs, "token").where("label != hub_label").where(_sizes_fit("n", "hub_n", percent)).where(_sketches_fit("o_", "n", "hub_n", percent))
            pairs = _ordered(pairs, "node", "hub")
        else:
            # exhaustive: members outside the largest component of their list against all members of other components
            before = F.transform(F.filter("early", lambda e: e["place"] < F.col("place")), lambda e: e["token"])
            labelled = labelled.join(_early_tokens(lists), "node").withColumn("before", before).drop("early")
            sizes = labelled.groupBy("token", "label").agg(F.count("*").alias("members"))
            largest = sizes.groupBy("token").agg(F.max(F.struct("members", "label")).alias("m")).select("token", F.col("m.label").alias("main"))
            outside = labelled.join(largest, "token").where("label != main").select(
                "token", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("n").alias("x_n"), F.col("place").alias("x_place"), F.col("before").alias("x_before"), *[F.col(c).alias(f"o_{c}") for c in SKETCH])
            left = F.least(F.col("n") - F.col("place"), F.col("x_n") - F.col("x_place"))
            needed = F.ceil(percent * (F.col("n") + F.col("x_n")) / (100 + percent))
            pairs = labelled.join(outside, "token").where("label != x_label").where(_sizes_fit("n", "x_n", percent)).where(left >= needed)
            pairs = pairs.where(_sketches_fit("o_", "n", "x_n", percent)).where(~F.arrays_overlap("before", "x_before"))
            pairs = _ordered(pairs, "node", "x")
        pairs, pairs_path = store(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            paths.append(pairs_path)
            continue
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node")
        sets, sets_path = store(_whole_sets(_keyed_texts(documents, wanted), width, percent), "sets")
        found, found_path = store(_verified(pairs, sets, percent).distinct(), "found")
        release(spark, sets_path)
        paths += [pairs_path, found_path]
        if found.isEmpty():
            tried = tried.union(pairs)
            continue
        links, tried = links.union(found), tried.union(pairs)
        if step < HUB_ROUNDS:
            labels, labels_path = store(_hub_labels(links), "labels")
            paths.append(labels_path)
    labels = connected_components(links)
    release(spark, *paths)
    joined = classes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("label"))
    named = every.join(joined, "set_key", "left").select("doc_id", "n", "label")
    smallest = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    out = named.join(smallest, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))
