"""Removal of repeated byte strings by a column-wise multi-document suffix order.

A string of ``length`` bytes is looked up through one of its own k-grams: the leftmost with the smallest hash. Equal strings elect it at the
same offset, so only occurrences of a shared elected k-gram can match, and they are compared aligned at it. For each such
group the suffixes are ordered column by column from the right: every round inserts one symbol of every segment, re-sorts
the order before by that symbol alone (as the Burrows-Wheeler transform of a collection is grown), and updates the common prefixes
of neighbours. Where a neighbour shares ``length`` symbols the string starting in that column occurs twice. The symbol columns lie in a
temporary file of the task that is read once, in order, and removed with the task.

Stages: count elected k-grams; keep occurrences of those met twice; cut their segments; make equal segments one (a segment met
twice is repeated throughout); order the distinct ones; send the runs back to the texts. Equal texts (by a 128-bit digest) form one class that is
processed once. A k-gram with more than ``GROUP_ROWS`` distinct segments does not meet in one task: its strings are counted by a
128-bit digest instead, which also is exact up to that digest. k-gram hashes only propose; symbols decide.

Defined cases: null or empty texts have no bytes; texts shorter than ``length`` lose nothing; overlapping occurrences count; repeated rows are
copies of each other; an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solea.llm.batches import arrow_slices, slices
from solea.session import release, store

GRAM = 64
GROUP_ROWS = 4096
TASK_ROWS = 16384
PIECE = 1 << 19
BROADCAST_ROWS = 1_000_000  # rows of a side that may be broadcast after counting; beyond it the join is shuffled
ABSENT = 256
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Elector:
    """Elected k-grams of texts: (hash, place, first and last start of the strings that elect it)."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.byte_value = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
        size = PIECE + length + 1
        self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)

    def elect(self, raw: bytes) -> np.ndarray:
        """Rows (hash, place, low, high) as int64."""
        out = []
        for first in range(0, max(1, len(raw) - self.length + 1), PIECE):
            piece = np.frombuffer(raw, np.uint8)[first : first + PIECE + self.length - 1]
            if len(piece) >= self.length:
                found = self._piece(piece)
                found[:, 1:] += first
                out.append(found)
        return np.concatenate(out) if out else np.zeros((0, 4), np.int64)

    def _piece(self, symbols: np.ndarray) -> np.ndarray:
        n, k = len(symbols), self.gram
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte_value[symbols] * self.up[:n], out=total[1:])
        mixed = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        place_bits = np.uint64(20)
        ranked = (mixed >> place_bits << place_bits) | np.arange(len(mixed), dtype=np.uint64)
        width = self.length - k + 1
        blocks = -(-len(ranked) // width)
        filled = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
        filled[: len(ranked)] = ranked
        filled = filled.reshape(blocks, width)
        before = np.minimum.accumulate(filled, 1).ravel()
        after = np.minimum.accumulate(filled[:, ::-1], 1)[:, ::-1].ravel()
        starts = n - self.length + 1
        chosen = (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        low = np.flatnonzero(np.diff(chosen, prepend=-1))
        high = np.append(low[1:], starts) - 1
        return np.stack([mixed[chosen[low]].view(np.int64), chosen[low], low, high], 1)


def repeated_starts(segments: list[bytes], group: np.ndarray, anchor: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each segment and each start before its anchor, whether the string starting there occurs in another segment of its group.

    Segments of a group are aligned at their anchor. Returns rows x (length - gram + 1) flags; column j is the start at anchor - j.
    """
    n, reach = len(segments), length - gram
    width = reach + length
    sizes = np.array([len(s) for s in segments])
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int32)  # symbols shared with the one before; the last entry ends the array
    flags = np.zeros((n, reach + 1), bool)
    with tempfile.TemporaryFile() as columns:
        step = max(1, (1 << 22) // max(n, 1))  # columns laid out at once
        flat = np.frombuffer(b"".join(segments), np.uint8).astype("<u2")
        begin = np.cumsum(sizes) - sizes
        for right in range(width, 0, -step):
            at = np.arange(right - 1, max(right - step, 0) - 1, -1)[:, None] - reach + anchor[None, :]  # place in the segment
            inside = (at >= 0) & (at < sizes)
            block = np.where(inside, flat[np.where(inside, at + begin, 0)], np.array(ABSENT, "<u2"))
            block.tofile(columns)
        columns.seek(0)
        for column in range(width - 1, -1, -1):
            symbol = np.frombuffer(columns.read(2 * n), "<u2")[order].astype(np.int64)
            key = group[order] * (ABSENT + 1) + symbol
            moved = np.argsort(key, kind="stable")
            key = key[moved]
            low = np.full(n, 0, np.int32)
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[moved[1:]] != ABSENT)) + 1
            if len(same):
                a, b = moved[same - 1], moved[same]
                spans = np.minimum.reduceat(common, np.stack([a + 1, b + 1], 1).ravel())[::2]
                low[same] = spans + 1
            order, common = order[moved], np.append(low, 0)
            if column <= reach:
                twice = (common[:-1] >= length) | (common[1:] >= length)
                flags[order[twice], reach - column] = True
    return flags


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _small_side(df: DataFrame, items: Column | None = None) -> DataFrame:
    """Broadcast only what has been counted as few rows, or as few ``items`` where a row holds an array of them."""
    counted = df.agg(F.coalesce(F.sum(items), F.lit(0))).first()[0] if items is not None else df.count()
    return F.broadcast(df) if counted <= BROADCAST_ROWS else df


def _merged(spans: Column) -> Column:
    """Maximal runs of each text's covered bytes; a batch stays in Arrow buffers, however many spans its texts have."""

    @F.arrow_udf("array<struct<first:int,end:int>>")
    def merged(spans: pa.Array) -> pa.Array:
        text = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
        flat = spans.flatten()
        first, end = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "end"))
        order = np.lexsort((first, text))
        text, first, end = text[order], first[order], end[order]
        reach = np.maximum.accumulate((text << 32) + end) - (text << 32)
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] > reach[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        runs = pa.StructArray.from_arrays([pa.array(first[at], pa.int32()), pa.array(reach[np.append(at, len(first))[1:] - 1], pa.int32())], ["first", "end"])
        bounds = np.append(0, np.cumsum(np.bincount(text[at], minlength=len(spans))))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)

    return merged(spans)


def _text_key(text: Column) -> Column:
    """128 bits of a digest: the key is shuffled with every place and segment."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _electors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, place, low, high, gram) of every elected k-gram."""

    @F.pandas_udf("array<struct<gram:long,place:int,low:int,high:int>>")
    def elect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        elector = Elector(length, gram)
        for batch in slices(batches):
            yield pd.Series([[(int(a), int(b), int(c), int(e)) for a, b, c, e in elector.elect(t.encode("utf-8", "surrogatepass"))] for t in batch], dtype=object)

    return texts.where(F.octet_length("text") >= length).select("d", F.explode(elect("text")).alias("x")).select("d", "x.*")


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """(d, starts, gram, anchor, key, segment): the distinct segments of every text around its shared k-grams."""

    kind = pa.list_(pa.struct({"key": pa.binary(), "gram": pa.int64(), "anchor": pa.int32(), "starts": pa.list_(pa.int32()), "segment": pa.binary()}))

    @F.arrow_udf("array<struct<key:binary,gram:long,anchor:int,starts:array<int>,segment:binary>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, found in arrow_slices(batches):
            out = []
            for t, places in zip(text, found):
                raw, own = t.encode("utf-8", "surrogatepass"), {}
                for x in places:
                    low, high, place = x["low"], x["high"], x["place"]
                    piece = raw[low : high + length]
                    key = xxhash.xxh3_128_digest(piece, seed=place - low)
                    own.setdefault(key, (int(x["gram"]), place - low, [], piece))[2].append(low)
                out.append([{"key": k, "gram": g, "anchor": a, "starts": s, "segment": p} for k, (g, a, s, p) in own.items()])
            yield pa.array(out, kind)

    return texts.select("d", F.explode(cut("text", "found")).alias("x")).select("d", "x.*")


def _ordered_runs(distinct: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, runs): first and last repeated start in each distinct segment, for groups that fit a task. Segments alone in their group have none."""
    tasks = max(1, -(-distinct.count() // TASK_ROWS))

    def order(own: pd.DataFrame) -> pd.DataFrame:
        own = own[own["gram"].duplicated(keep=False)]
        if own.empty:
            return pd.DataFrame({"key": [], "runs": []})
        flags = repeated_starts(own["segment"].tolist(), pd.factorize(own["gram"])[0], own["anchor"].to_numpy(np.int64), length, gram)
        rows = []
        for key, anchor, flag in zip(own["key"], own["anchor"], flags):
            if flag.any():
                rows.append((key, [{"first": a, "last": b} for a, b in _runs(flag[anchor::-1])]))
        return pd.DataFrame(rows, columns=["key", "runs"])

    dealt = distinct.withColumn("task", F.pmod(F.xxhash64("gram"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(order, "key binary, runs array<struct<first:int,last:int>>")


def _dealt(distinct: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct segments of the groups that fit a task, and of the larger ones, without shuffling segments for it.

    ``groups(gram, members)`` has the k-grams with several segments. If they are too many to broadcast, only the larger ones are (each stands for more than
    ``GROUP_ROWS`` segments), and segments alone in their group stay among the first ones.
    """
    larger = groups.where(F.col("members") > GROUP_ROWS).select("gram")
    if groups.count() <= BROADCAST_ROWS:
        first = distinct.join(F.broadcast(groups.where(F.col("members") <= GROUP_ROWS).select("gram")), "gram", "left_semi")
    else:
        first = distinct.join(_small_side(larger), "gram", "left_anti")
    return first, distinct.join(_small_side(larger), "gram", "left_semi")


def _counted_runs(distinct: DataFrame, length: int) -> DataFrame:
    """The same for k-grams with very many distinct segments: every string by its digest, without bringing a group together."""

    @F.arrow_udf("array<binary>")
    def strings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (segments,) in arrow_slices((batch,) for batch in batches):
            yield pa.array([[xxhash.xxh3_128_digest(s[i : i + length]) for i in range(len(s) - length + 1)] for s in segments], pa.list_(pa.binary()))

    each = distinct.select("key", "copies", F.posexplode(strings("segment")).alias("start", "string"))
    twice = each.groupBy("string").agg(F.sum("copies").alias("met")).where("met > 1").select("string")
    hit = each.join(twice, "string").groupBy("key").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    return hit.select("key", F.transform("starts", lambda s: F.struct(s.alias("first"), s.alias("last"))).alias("runs"))


def remove_repeats(documents: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans of every document."""
    spark = documents.sparkSession
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("d", _text_key(F.col("text")))
    classes = keyed.groupBy("d").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))
    copied, copied_path = store(classes.where("copies > 1"), "copies")
    copied = _small_side(copied)
    with_copies = keyed.join(copied, "d", "left")
    texts = with_copies.where("copies IS NULL OR doc_id = one OR one IS NULL").select("d", "text")

    elected, elected_path = store(_electors(texts, length, gram), "elected")
    shared, shared_path = store(elected.groupBy("gram").agg(F.count("*").alias("met")).where("met > 1").select("gram"), "shared")
    places, places_path = store(elected.join(_small_side(shared), "gram"), "places")
    release(spark, elected_path, shared_path)
    found = places.groupBy("d").agg(F.collect_list(F.struct("gram", "place", "low", "high")).alias("found"))  # meets its text in the same shuffle
    involved = texts.join(_small_side(places.select("d").distinct()), "d", "left_semi").dropDuplicates(["d"]).join(found, "d")
    occurrences, occurrences_path = store(_segments(involved, length), "segments")
    release(spark, places_path)

    distinct = occurrences.groupBy("key").agg(
        F.sum(F.size("starts")).alias("copies"), F.first("gram").alias("gram"), F.first("anchor").alias("anchor"), F.first("segment").alias("segment"))
    distinct, distinct_path = store(distinct, "distinct")
    groups, groups_path = store(distinct.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    fitting, larger = _dealt(distinct, groups)
    small, large = _ordered_runs(fitting, length, gram), _counted_runs(larger, length)
    whole = distinct.where("copies > 1").select("key", F.array(F.struct(F.lit(0).alias("first"), (F.octet_length("segment") - length).alias("last"))).alias("runs"))
    runs, runs_path = store(small.union(large).union(whole).select("key", F.explode("runs").alias("run")), "runs")

    hit = occurrences.select("d", "key", "starts").join(runs, "key").select("d", F.explode("starts").alias("low"), "run")
    spans = hit.groupBy("d").agg(F.collect_set(F.struct((F.col("low") + F.col("run.first")).alias("first"), (F.col("low") + F.col("run.last") + length).alias("end"))).alias("spans"))
    spans = spans.select("d", _merged(F.col("spans")).alias("spans"))
    spans, spans_path = store(spans, "spans")
    release(spark, occurrences_path, distinct_path, groups_path, runs_path)

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, copies, spans in slices(batches):
            rows = []
            for t, many, own in zip(text, copies, spans):
                raw = t.encode("utf-8", "surrogatepass")
                edge = np.zeros(len(raw) + 1, np.int64)
                if many == many and many is not None and len(raw) >= length:
                    edge[0], edge[-1] = 1, -1
                elif own is not None:
                    for x in own:
                        edge[x["first"]] += 1
                        edge[x["end"]] -= 1
                covered = np.cumsum(edge)[:-1] > 0
                starts = int(np.count_nonzero(np.diff(covered.astype(np.int8), prepend=0) == 1)) if len(raw) else 0
                rows.append((np.frombuffer(raw, np.uint8)[~covered].tobytes(), len(raw), int(covered.sum()), starts))
            yield pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    done = with_copies.join(_small_side(spans, F.size("spans")), "d", "left").select("doc_id", keep("text", "copies", "spans").alias("k"))
    return done.select("doc_id", "k.*")


def repeat_digests(documents: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return remove_repeats(documents, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
