"""How far the word use of each source of a language is from that of the other sources and of the whole language, in whole numbers.

Counting is an Arrow pipeline inside ``mapInArrow``: a block of whole texts is lowered (``ascii_lower``), split at everything that is not a letter
(``split_pattern_regex``), coded (``dictionary_encode``) and counted by hash ``group_by`` into partial rows (lang, source, term, occurrences, documents). One
shuffle by (lang, term) merges the partial rows, which are already reduced block by block, so a hot term or source arrives as one row for each block.
A term then is one row with its counts in all sources, and the terms that are in enough documents of the language are stored as columns.

The stored terms are dealt to shards of a language, at most ``SHARD_CELLS`` (term, source) cells each, whatever the size of the language. A shard and the
totals of all groups of its language make a matrix; probabilities and divergences are integer array steps on it. A shard gives one partial sum for each
pair of sources and its own first terms, which are merged by a sum and by ranks.

p = 1 + floor(SCALE * (count + 1) / (N + V)) for a group with N occurrences of kept terms and V kept terms of the language;
f = floor((p - q)^2 / q). All of it is integer arithmetic: SCALE is applied in three steps of 1000, so that nothing passes 64 bits below 9 * 10^15 occurrences.

Defined cases: null text, lang and source are ''; a text may be of any length (a longer one is a block of its own) or have no terms; repeated rows are documents of their own; a group
without terms keeps its pair rows, and a language without kept terms has the value 0 in all of them; a language with one source has no pair
rows; equal values are ranked by the UTF-8 bytes of the item; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solea.llm.token_counts import blocks
from solea.session import store

NOT_A_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_CELLS = 1 << 20
_PARTIAL = "lang string, source string, term string, n long, docs long"
_ROWS = "lang string, source string, part string, item string, value long"


def _coded(column: pa.Array) -> pa.DictionaryArray:
    return pc.fill_null(column.cast(pa.string()), "").dictionary_encode()


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of one block; term '' stands for the group itself."""
    lang, source = _coded(batch["lang"]), _coded(batch["source"])
    sources = max(len(source.dictionary), 1)
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), sources), source.indices.cast(pa.int64()))
    texts = pc.take(batch["text"], pa.array(np.arange(batch.num_rows)))  # a copy: ascii_lower misreads a slice whose bytes begin further on
    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NOT_A_LETTER)
    text, term = pc.list_parent_indices(words).cast(pa.int64()), pc.list_flatten(words)
    there = pc.not_equal(term, "")
    coded = term.filter(there).dictionary_encode()
    seen = pa.table({"text": text.filter(there), "term": coded.indices}).group_by(["text", "term"], use_threads=False).aggregate([([], "count_all")])
    held = pa.table({"group": pc.take(group, seen["text"]), "term": seen["term"], "n": seen["count_all"]})
    counted = held.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    groups = pc.unique(group)
    number = pa.concat_arrays([counted["group"].combine_chunks(), groups]).to_numpy()
    terms = pa.concat_arrays([pc.take(coded.dictionary, counted["term"].combine_chunks()), pa.array([""] * len(groups), pa.large_string())])
    none = np.zeros(len(groups), np.int64)
    return pa.table({
        "lang": pc.take(lang.dictionary, pa.array(number // sources)), "source": pc.take(source.dictionary, pa.array(number % sources)), "term": terms.cast(pa.string()),
        "n": np.concatenate([counted["n_sum"].to_numpy(), none]), "docs": np.concatenate([counted["count_all"].to_numpy(), none]),
    })


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        for block in blocks(batch["text"]):
            yield from term_counts(batch.slice(start, len(block))).combine_chunks().to_batches()
            start += len(block)


def _probabilities(count: np.ndarray, total: np.ndarray, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 1) / total); scale is a power of 1000, applied by long division."""
    whole, rest = np.zeros_like(count), count + 1
    while scale > 1:
        whole, rest, scale = whole * 1000 + rest * 1000 // total, rest * 1000 % total, scale // 1000
    return whole + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shard(key: tuple, terms: pa.Table, groups: pa.Table, top: int, scale: int) -> pa.Table:
    """Partial pair sums of all groups of the language over the shard's terms, and the first terms of each group in this shard."""
    sources, own = groups["source"].to_pylist(), groups["own"].to_numpy()
    kinds, rows = terms.num_rows, {s: i for i, s in enumerate(sources)}
    count = np.zeros((len(sources), kinds), np.int64)
    lists = terms["counts"].combine_chunks()
    if kinds:
        cells = pc.list_flatten(lists)
        count[[rows[s] for s in cells.field("source").to_pylist()], pc.list_parent_indices(lists).to_numpy()] = cells.field("n").to_numpy()
    whole, kept = (groups[c][0].as_py() if len(sources) else 0 for c in ("whole", "kept"))
    names = terms["term"].combine_chunks() if kinds else pa.array([], pa.string())  # a side without rows has no types
    place = np.empty(kinds, np.int64)
    place[pc.sort_indices(names).to_numpy()] = np.arange(kinds)  # order of the UTF-8 bytes
    p = _probabilities(count, (own + kept)[:, None], scale)
    language = _probabilities(count.sum(0), np.int64(whole + kept), scale)
    out = []
    for s, source in enumerate(sources):
        out.append(([source] * len(sources), ["pair"] * len(sources), sources, _divergence(p[s], p).sum(1)))
        more = np.flatnonzero((count[s] > 0) & (p[s] > language))
        value = _divergence(p[s, more], language[more])
        first = np.lexsort((place[more], -value))[:top]
        out.append(([source] * len(first), ["term"] * len(first), names.take(pa.array(more[first])).to_pylist(), value[first]))
    made = {n: [x for part in out for x in part[i]] for i, n in enumerate(("source", "part", "item", "value"))}
    table = pa.table({"lang": pa.array([key[0].as_py()] * len(made["part"]), pa.string()), **{n: pa.array(made[n], pa.string()) for n in ("source", "part", "item")},
                      "value": pa.array(made["value"], pa.int64())})
    return table.filter(pc.or_(pc.equal(table["part"], "term"), pc.not_equal(table["source"], table["item"])))


def source_divergence(documents: DataFrame, least_documents: int = 3, top: int = 200, scale: int = 10**9) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from every other source (part ``pair``) and the first ``top`` overused terms (part ``term``)."""
    partial = documents.select("lang", "source", "text").mapInArrow(_partial_counts, _PARTIAL)
    by_source = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    merged, _ = store(by_term.where((F.col("docs") >= least_documents) | (F.col("term") == "")).select("lang", "term", "counts"), "terms")

    cells = merged.select("lang", "term", F.explode("counts").alias("c")).select("lang", "c.source", "c.n", (F.col("term") != "").alias("kept"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    language = own.groupBy("lang").agg(F.sum("own").alias("whole"), F.count("*").alias("sources"))
    sizes = language.join(merged.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kept")), "lang")
    sizes, _ = store(sizes.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("sources") / SHARD_CELLS)).cast("int")), "languages")
    dealt = merged.where("term != ''").join(sizes.select("lang", "shards"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "term", "counts")
    totals = own.join(sizes, "lang").select(  # named anew: both sides of the cogroup come from one table
        F.col("lang").alias("lang"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", "own", "whole", "kept")

    def divergences(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
        return _shard(key, terms, groups, top, scale)

    found, _ = store(dealt.groupBy("lang", "shard").cogroup(totals.groupBy("lang", "shard")).applyInArrow(divergences, _ROWS), "divergences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(found.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return both.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
             coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
  groups AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  grid AS (SELECT g.lang, g.source, k.term, k.all_n, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
  sums AS (SELECT lang, source, sum(n) AS own, count(*) AS v, sum(all_n) AS whole FROM grid GROUP BY lang, source),
  p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (own + v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (all_n + 1)) // (whole + v)::HUGEINT AS pl
        FROM grid JOIN sums USING (lang, source)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  terms AS (SELECT lang, source, term AS item, (p - pl) * (p - pl) // pl AS value FROM p WHERE n > 0 AND p > pl),
  both_parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs q ON q.lang = a.lang AND q.source = a.source AND q.item = b.source UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 200
"""
