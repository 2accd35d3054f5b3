"""Masked pseudo-likelihood of texts under a bidirectional window network.

The network predicts every unit of a text from two units on each side: an embedding for each of the four places, one hidden layer, and an output in two
steps (a class of units, then the unit in its class). The most frequent words of the whole corpus are one unit each; every other word is spelled out in
pieces of its UTF-8 bytes and an end mark, from its front always the longest piece that fits, so that no two words look alike. Pieces are single bytes and
strings of up to eight that byte pair merging finds in the counted words that come next in frequency. A text's score is the sum of the log-probabilities of all
its words, each one hidden in turn as a whole: a piece sees what comes before it and, to its right, only what follows its word, so the product over a
word's units is the probability of that spelling of the word among all possible ones.

All documents count. Word counts are exact over the corpus; in each training round every partition trains on windows of all its documents
(every ``rounds``-th unit, another offset in each round, so that all rounds together have every unit once as target) from the common weights, and the
weights are averaged by the number of windows, chunk by chunk in two levels so that no task gathers all copies. What is gathered grows with the corpus; the model has a fixed size.

Defined cases: null, empty and wordless texts have no tokens, score 0 and no mean; places outside the text are a padding token; repeated rows
score alike; with an empty corpus nothing is returned. Only the id and the text are read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solea.session import release, store

FREQUENT, BYTES, CLASS = 768, 256, 32
VOCABULARY = FREQUENT + BYTES
END = FREQUENT + ord(" ")  # ends a spelled word; words hold no space
PLACES = (-2, -1, 1, 2)
HIDDEN = 32
CHUNK = 8192
SLICE = 1 << 24  # characters whose words are looked up together
PIECES = 1024  # beside the single bytes
LONGEST = 8  # bytes of a piece
EXAMPLES = 16384  # words from whose counts pieces are learned
SHORT = 64  # bytes of words that are spelled from unit to unit
RUN = 12  # rows of a run that are added up place by place
BLANKS = bytes(ord(" ") if bytes([b]).isspace() else b for b in range(256))


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def word_hashes(text: str | None) -> np.ndarray:
    return _hashes(_words(text))


def _slices(texts: Sequence[str | None]) -> Iterator[list[str | None]]:
    """Neighbouring texts of together about ``SLICE`` characters."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _spelled(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, a blank behind each; which of them every word is; the number of words of each text."""
    lowered = [(text or "").lower().encode("utf-8", "surrogatepass") for text in texts]
    letters = np.frombuffer(b" ".join([*lowered, b""]).translate(BLANKS), np.uint8)
    blank = letters == ord(" ")
    ends = blank & ~np.append(True, blank[:-1])[: len(blank)]
    words = np.diff(np.searchsorted(np.flatnonzero(ends), np.cumsum([0] + [len(own) + 1 for own in lowered])))
    spelled = letters[~blank | ends]
    first = np.append(0, np.flatnonzero(spelled == ord(" ")) + 1).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(first), pa.py_buffer(spelled)]).dictionary_encode()
    return every.dictionary, every.indices.to_numpy(), words


def learned_pieces(words: list[bytes], counts: list[int], most: int) -> list[bytes]:
    """Byte pair merging on counted words with their end mark: the most frequent neighbours become one piece, again and again; ties to the smaller bytes."""
    spelled = [[bytes([b]) for b in word + b" "] for word in words]
    pairs, where = defaultdict(int), defaultdict(set)
    for k, (own, n) in enumerate(zip(spelled, counts)):
        for pair in zip(own, own[1:]):
            pairs[pair] += n
            where[pair].add(k)
    heap = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    found: dict[bytes, None] = {}
    while heap and len(found) < most:
        n, pair = heapq.heappop(heap)
        if pairs[pair] != -n or not n or len(pair[0] + pair[1]) > LONGEST:
            continue  # no longer its count, or too long
        piece = pair[0] + pair[1]
        found[piece] = None
        changed = set()
        for k in where.pop(pair):
            old, new, at = spelled[k], [], 0
            while at < len(old):
                two = at + 1 < len(old) and (old[at], old[at + 1]) == pair
                new.append(piece if two else old[at])
                at += 1 + two
            for sign, own in ((-counts[k], old), (counts[k], new)):
                for other in zip(own, own[1:]):
                    pairs[other] += sign
                    changed.add(other)
                    if sign > 0:
                        where[other].add(k)
            spelled[k] = new
        for other in changed:
            if pairs[other] > 0:
                heapq.heappush(heap, (-pairs[other], other))
    return list(found)


class Units:
    """Spells words: those in ``whole`` with the unit named there; all others with pieces, single bytes and the end mark."""

    def __init__(self, whole: dict[bytes, int], pieces: Sequence[bytes] = ()):
        self.words, self.ids = pa.array([word + b" " for word in whole], pa.binary()), np.array(list(whole.values()), np.int16)
        self.tables = []
        for size in range(LONGEST, 1, -1):
            some = [k for k, piece in enumerate(pieces) if len(piece) == size]
            if some:
                keys = np.array([int.from_bytes(pieces[k], "little") for k in some], np.uint64)
                self.tables.append((size, pa.array(keys), np.array(some, np.int16) + VOCABULARY))

    def _walk(self, at: np.ndarray, end: np.ndarray, ahead: np.ndarray, unit: np.ndarray, size: np.ndarray, used: np.ndarray, fitted: bool) -> None:
        """Marks the units of words from ``at`` to ``end``, the next one of all words at a time."""
        while len(at):
            if not fitted:
                self._fit(at, ahead, unit, size)
            used[at] = True
            at = at + size[at]
            more = at < end
            at, end = at[more], end[more]

    def _fit(self, at: np.ndarray, ahead: np.ndarray, unit: np.ndarray, size: np.ndarray) -> None:
        """The longest piece from each of these bytes on, and its length."""
        for length, keys, ids in self.tables:
            own = ahead[at] & np.uint64(256**length - 1)
            found = pc.fill_null(pc.index_in(pa.array(own), value_set=keys), -1).to_numpy()
            hit = found >= 0
            unit[at[hit]], size[at[hit]] = ids[found[hit]], length
            at = at[~hit]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        distinct, index, words = _spelled(texts)
        if not len(index):
            return [np.zeros(0, np.int16)] * len(texts)
        edges = np.append(0, np.cumsum(pc.binary_length(distinct).to_numpy()))
        letters = distinct.buffers()[2].to_pybytes()[: edges[-1]]
        first, end = edges[:-1], edges[1:]
        unit = np.frombuffer(letters, np.uint8).astype(np.int16) + FREQUENT
        size, used = np.ones(len(letters), np.int8), np.zeros(len(letters), bool)
        ahead = np.ndarray(len(letters), "<u8", letters + bytes(LONGEST), strides=(1,))
        found = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy()
        whole = found >= 0
        unit[first[whole]] = self.ids[found[whole]]
        used[first[whole]] = True
        long = ~whole & (end - first > SHORT)
        if long.any():  # these take many steps
            self._fit(np.flatnonzero(np.repeat(long, end - first)), ahead, unit, size)
        self._walk(first[long], end[long], ahead, unit, size, used, True)
        self._walk(first[~whole & ~long], end[~whole & ~long], ahead, unit, size, used, False)
        at = np.flatnonzero(used)
        spelled, begin = unit[at], np.searchsorted(at, edges)
        sizes = np.diff(begin)[index]
        behind = np.cumsum(sizes)
        out = spelled[np.repeat(begin[index] - behind + sizes, sizes) + np.arange(behind[-1])]
        kept = np.append(0, behind)[np.append(0, np.cumsum(words))].tolist()
        return [out[a:b] for a, b in zip(kept, kept[1:])]


def units(text: str | None, known: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The units of a text without longer pieces; whole are the words whose hash is among the sorted ``known``, their unit is its rank in ``order``."""
    words = list(set(_words(text)))
    hashes = _hashes(words)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return Units({w: int(order[k]) for w, k, h in zip(words, at, hashes) if known[k] == h})([text])[0]


def lasts(pieces: Sequence[bytes] = ()) -> np.ndarray:
    """Whether a unit ends a word, for all units and the padding token behind them."""
    out = np.zeros(VOCABULARY + len(pieces) + 1, bool)
    out[:FREQUENT] = out[END] = out[-1] = True
    out[VOCABULARY:-1] = [piece.endswith(b" ") for piece in pieces]
    return out


def windows_of(texts: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """Two units before every unit and two behind the end of its word, in four rows; beyond a text stands the padding token."""
    outside = np.full(3, len(last) - 1, np.int16)
    ids = np.concatenate([outside, *(x for text in texts for x in (text, outside)), outside[:2]], dtype=np.int16, casting="unsafe")
    here = ids[2:-2]
    ends = np.flatnonzero(last[here])
    word = np.diff(ends, prepend=-1)
    out = np.stack([ids[:-4], ids[1:-3], np.repeat(ids[ends + 3], word), np.repeat(ids[ends + 4], word)])
    return out[:, here != len(last) - 1]


def _vocabulary(documents: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words of all documents, most frequent first; pieces for spelling the others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _slices(batch.column(0).to_pylist()):
                distinct, index, _ = _spelled(texts)
                yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(index, minlength=len(distinct)), pa.int64())], ["word", "n"])

    counts = documents.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted, folder = store(counts, "word-counts")
    level, least, words = F.floor(8 * F.log2("n")), 0, 0
    for least, some in sorted(counted.groupBy(level).count().collect(), reverse=True):  # at most 8 rows for each binary digit of a count
        words += some
        if words >= FREQUENT + EXAMPLES:
            break
    often = counted.where(level >= least)  # without it, every partition would send that many words to the driver
    top = often.orderBy(F.desc("n"), "word").limit(FREQUENT + EXAMPLES).collect()  # a fixed number of rows
    release(documents.sparkSession, folder)
    words, times = [bytes(r["word"])[:-1] for r in top], [r["n"] for r in top]
    return words[:FREQUENT], learned_pieces(words[FREQUENT:], times[FREQUENT:], PIECES)


def _with_ids(documents: DataFrame, frequent: list[bytes], pieces: list[bytes]) -> DataFrame:
    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spell = Units({word: k for k, word in enumerate(frequent)}, pieces)
        for texts in batches:
            yield pd.Series([own.astype("<i2", copy=False).tobytes() for some in _slices(texts) for own in spell(some)], dtype=object)

    return documents.select("doc_id", ids("text").alias("ids"))


class WindowNetwork:
    """Weights as one flat array, so that they can be averaged; views name its parts."""

    def __init__(self, flat: np.ndarray | None = None, vocabulary: int = VOCABULARY):
        self.vocabulary, self.bits = vocabulary, 5 if vocabulary <= CLASS**2 else 6
        self.width = 1 << self.bits
        classes = -(-vocabulary // self.width)
        shapes = {
            "embed": (len(PLACES), vocabulary + 1, HIDDEN), "hidden_bias": (HIDDEN,),
            "to_class": (HIDDEN + 1, classes), "to_word": (classes, HIDDEN + 1, self.width),  # their last input is always 1
        }
        sizes = {k: int(np.prod(s)) for k, s in shapes.items()}
        total = sum(sizes.values())
        self.flat = np.random.default_rng(9).normal(0, 0.05, total).astype(np.float32) if flat is None else flat.copy()
        self.slope2 = np.full(total, 1e-3, np.float32)
        self.slopes2, at = {}, 0
        for name, shape in shapes.items():
            setattr(self, name, self.flat[at : at + sizes[name]].reshape(shape))
            self.slopes2[name] = self.slope2[at : at + sizes[name]].reshape(shape)
            at += sizes[name]
        if vocabulary % self.width:
            self.to_word[-1, -1, vocabulary % self.width :] = -100  # no such units

    @staticmethod
    def windows(ids: np.ndarray) -> np.ndarray:
        """Two units before every unit and two behind the end of its word; beyond the text stands the padding token."""
        return windows_of([ids], lasts()).T

    def _hidden(self, places: np.ndarray) -> np.ndarray:
        total = self.hidden_bias + np.take(self.embed[0], places[0], 0, mode="clip")  # all are in range; unchecked is faster
        for k in range(1, len(PLACES)):
            total += np.take(self.embed[k], places[k], 0, mode="clip")
        out = np.ones((len(total), HIDDEN + 1), np.float32)
        np.tanh(total, out=out[:, :-1])
        return out

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The order that brings targets of a class together, their classes in it, and (class, first, end) of each."""
        kind = (target >> self.bits).astype(np.uint8)  # short keys are sorted in linear time
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        edges = np.searchsorted(kind, np.arange(len(self.to_word) + 1)).tolist()
        return order, kind.astype(np.int64), [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]

    def _word_logits(self, hidden: np.ndarray, own: list[tuple[int, int, int]]) -> np.ndarray:
        out = np.empty((len(hidden), self.width), np.float32)
        for c, a, b in own:
            np.dot(hidden[a:b], self.to_word[c], out=out[a:b])
        return out

    @staticmethod
    def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of logits and their sums; where they could overflow, the logits are first overwritten by themselves less their row's largest."""
        if not -60 < x.min(initial=0) <= x.max(initial=0) < 60:
            x -= x.max(1, keepdims=True)
        e = np.exp(x)
        return e, e @ np.ones(x.shape[1], np.float32)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, kind, own = self._by_class(target)
        rows, hidden = np.arange(len(target)), self._hidden(context.T.take(order, 1))
        found = np.zeros(len(target))
        for logits, wanted in ((hidden @ self.to_class, kind), (self._word_logits(hidden, own), target[order] & self.width - 1)):
            _, total = self._exponentials(logits)
            found += logits[rows, wanted] - np.log(total)
        out = np.empty(len(target))
        out[order] = found
        return out

    def train(self, context: np.ndarray, target: np.ndarray, step: float) -> None:
        """One step of adaptive gradient descent on the mean log-probability; embeddings of units outside the batch have no slope and stay."""
        order, kind, own = self._by_class(target)
        places, word, n = context.T.take(order, 1), target[order] & self.width - 1, len(target)
        share = np.float32(1 / n)
        rows, hidden = np.arange(n), self._hidden(places)

        def misses(logits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            e, total = self._exponentials(logits)
            e *= (share / total)[:, None]
            e[rows, wanted] -= share
            return e

        p = misses(hidden @ self.to_class, kind)
        q = misses(self._word_logits(hidden, own), word)
        back = np.empty((n, HIDDEN), np.float32)
        to_word = np.empty((len(own), HIDDEN + 1, self.width), np.float32)
        for i, (c, a, b) in enumerate(own):
            np.dot(hidden[a:b].T, q[a:b], out=to_word[i])
            np.dot(q[a:b], self.to_word[c, :-1].T, out=back[a:b])
        back += p @ self.to_class[:-1].T
        back *= 1 - hidden[:, :-1] ** 2
        self._move(self.to_class, self.slopes2["to_class"], slice(None), hidden.T @ p, step)
        self._move(self.to_word, self.slopes2["to_word"], np.array([c for c, _, _ in own]), to_word, step)
        self._move(self.hidden_bias, self.slopes2["hidden_bias"], slice(None), np.ones(n, np.float32) @ back, step)
        met = (places + np.arange(len(PLACES))[:, None] * (self.vocabulary + 1)).astype(np.uint16).ravel()  # rows of all embeddings one below the other
        by_row = np.argsort(met, kind="stable")
        met, row = met[by_row], np.tile(rows, len(PLACES))[by_row]
        first = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
        for runs, slopes in self._sums(back, row, first):
            self._move(self.embed.reshape(-1, HIDDEN), self.slopes2["embed"].reshape(-1, HIDDEN), met[first[runs]], slopes, step)

    @staticmethod
    def _sums(back: np.ndarray, row: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs and the sums of the rows ``row`` of ``back`` in each. Most runs are short: their first rows are added up at once, then their second ones and so on."""
        size = np.diff(first, append=len(row))
        large = np.flatnonzero(size > RUN)
        if len(large):
            some = back.take(row[np.repeat(size > RUN, size)], 0)
            yield large, np.add.reduceat(some.view(np.complex64), np.cumsum(size[large]) - size[large]).view(np.float32)  # two numbers at a time
        small = np.flatnonzero(size <= RUN)
        small = small[np.argsort(-size[small].astype(np.int8), kind="stable")]
        begin, size = first[small], -size[small]
        total = back.take(row[begin], 0)
        for k in range(1, RUN):
            longer = np.searchsorted(size, -k)
            total[:longer] += back.take(row[begin[:longer] + k], 0)
        yield small, total

    @staticmethod
    def _move(weights: np.ndarray, slopes2: np.ndarray, at, slope: np.ndarray, step: float) -> None:
        rows = isinstance(at, np.ndarray)
        squares = slope * slope
        squares += slopes2.take(at, 0, mode="clip") if rows else slopes2
        slopes2[at] = squares
        slope /= np.sqrt(squares, out=squares)
        slope *= np.float32(-step)
        slope += weights.take(at, 0, mode="clip") if rows else weights
        weights[at] = slope


def picked(n: int, offset: int, rounds: int) -> np.ndarray:
    """Targets of one round in a text of n units; the offsets 0 to rounds - 1 together pick every unit once, however short the text."""
    return np.arange((offset + n) % rounds, n, rounds)


def _averaged(ids: DataFrame, weights: np.ndarray, last: np.ndarray, offset: int, rounds: int, batch: int, step: float) -> np.ndarray:
    """One round: every partition trains from the common weights; the results are averaged by windows."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seen = WindowNetwork(weights, len(last) - 1), 0


        def learn(texts: list[np.ndarray]) -> int:
            pick = np.concatenate([at + picked(len(t), offset, rounds) for at, t in zip(np.cumsum([0] + [len(t) for t in texts]), texts)])
            context, target = windows_of(texts, last)[:, pick].T, np.concatenate(texts)[pick]
            for at in range(0, len(target), batch):
                model.train(context[at : at + batch], target[at : at + batch], step)
            return len(target)

        waiting, size = [], 0
        for frame in batches:
            for raw in frame["ids"]:
                waiting.append(np.frombuffer(raw, "<i2"))
                size += len(waiting[-1])
                if size >= 16 * batch * rounds:
                    seen += learn(waiting)
                    waiting, size = [], 0
        if size:
            seen += learn(waiting)
        if seen:
            chunks = range(0, len(model.flat), CHUNK)
            yield pd.DataFrame({"chunk": list(range(len(chunks))), "windows": seen, "weights": [model.flat[c : c + CHUNK].astype("<f4").tobytes() for c in chunks]})

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        share = rows["windows"].to_numpy(np.float64)
        total = sum(w * np.frombuffer(x, "<f4").astype(np.float64) for w, x in zip(share / share.sum(), rows["weights"]))
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "windows": [int(share.sum())], "weights": [total.astype("<f4").tobytes()]})

    shape = "chunk int, windows long, weights binary"
    trained = ids.select("ids").mapInPandas(train, shape).withColumn("part", F.floor(F.sqrt(F.spark_partition_id())))
    some = trained.groupBy("chunk", "part").applyInPandas(lambda rows: average(rows), shape)
    found = some.groupBy("chunk").applyInPandas(lambda rows: average(rows), shape).orderBy("chunk").collect()  # the weights of one model
    return np.concatenate([np.frombuffer(r["weights"], "<f4") for r in found]) if found else weights


def pseudo_likelihood(documents: DataFrame, rounds: int = 2, batch: int = 2048, step: float = 0.1) -> DataFrame:
    """doc_id, n_tokens, score (sum of log-probabilities) and mean_score of every document."""
    frequent, pieces = _vocabulary(documents)
    last = lasts(pieces)
    ids, _ = store(_with_ids(documents, frequent, pieces), "word-ids")
    weights = WindowNetwork(None, len(last) - 1).flat
    for n in range(rounds):
        weights = _averaged(ids, weights, last, n, rounds, batch, step)

    @F.pandas_udf("n_tokens long, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = WindowNetwork(weights, len(last) - 1)
        for batch_ids in batches:
            texts = [np.frombuffer(raw, "<i2") for raw in batch_ids]
            totals, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            first = 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and size < 65536:
                    size += len(texts[end])
                    end += 1
                context, target = windows_of(texts[first:end], last).T, np.concatenate(texts[first:end])
                found = np.concatenate([np.zeros(0), *(model.log_probability(context[i : i + 4096], target[i : i + 4096]) for i in range(0, size, 4096))])
                owner = np.repeat(np.arange(first, end), [len(t) for t in texts[first:end]])
                totals += np.bincount(owner, found, len(texts))
                words += np.bincount(owner[last[target]], minlength=len(texts))
                first = end
            yield pd.DataFrame({"n_tokens": words, "score": totals})

    scored = ids.select("doc_id", score("ids").alias("s")).select("doc_id", "s.n_tokens", "s.score")
    return scored.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))
