"""BPE encoding and decoding by speculation and verification.

Words are proposed tokens by greedy longest match (one pass of an automaton over all new words of a block). A proposal is
the BPE result exactly when every token merges to itself and no adjacent pair would have merged across its border
earlier; those pairs are checked in bulk on arrays. Words with a failing pair, and only those, are merged exactly.

Why pair checks suffice: a token's merge rank is above its parts' ranks, so at any moment the pieces that touch a border are
the nodes on the right edge of the left token's merge tree and on the left edge of the right one's. A foreign merge of pieces
(x, y) happens if its rank comes before x's own next merge (equal rank: x is further left, so x's goes first) and not after y's.

The vocabulary file is read on the driver and travels as arrays; executors need no file. One pass, no shuffle; the table of
words seen is emptied when it reaches ``WORD_LIMIT`` words, which changes no result.

Defined cases: a null or empty text has no tokens and decodes to the empty text; ids outside the vocabulary and nulls are skipped in
decoding. Other columns are kept by ``add_token_ids`` and ``add_decoded_text``; an existing output column of the given name is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_LIMIT = 150_000
SLICE_ROWS = 256
BLOCK_CHARS = 1_000_000
NEVER = 1 << 40
# Characters of the Unicode property White_Space
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

# Letters and lower cases of Unicode 16 and 17 that the interpreter's own tables (15.1) lack
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_LOWER = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {upper: upper + 0x20 for upper in range(0x10D50, 0x10D66)}
    | {upper: upper + 0x1B for upper in range(0x16EA0, 0x16EB9)}
)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind: itself, or the next free one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


def _ranges(kind: str, below: int) -> str:
    """All characters of a general category (its first letter) below a code point, as ranges for a character class."""
    found = [unicodedata.category(chr(p))[0] for p in range(below)]
    if kind == "L":
        for first, last in LATER_LETTERS:
            for p in range(first, min(last + 1, below)):
                found[p] = "L"
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{kind}+", "".join(found)))


def word_pattern(split: str, below: int) -> str:
    """The split pattern for texts whose characters are all below a code point; small classes are much faster.

    Letters and digits are tried first: the endings before them all start with an apostrophe, so the order between them is free.
    """
    endings, found, _ = split.partition("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
    if not found or not all(e.startswith("'") for e in endings.split("|")):
        raise ValueError(f"unknown split pattern {split}")
    letters, numbers = _ranges("L", below), _ranges("N", below)
    return f"[{letters}]+|[{numbers}]|{endings}|[^{WHITE_SPACE}{letters}{numbers}]+"


@dataclass
class Vocabulary:
    """Tokens and merges as arrays. ``left``/``right`` are -1 for base symbols; ``rank`` of a base symbol is -1."""

    names: list[str]
    forms: list[bytes | None]  # a token's bytes, None for special tokens
    ends: np.ndarray  # whether the token ends a word
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    special: dict[str, int]
    patterns: list[tuple[int, str]]
    merge_keys: np.ndarray = None  # sorted left * size + right
    merge_token: np.ndarray = None
    sound: np.ndarray = None  # tokens that merge to themselves

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocab, suffix = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        names, forms = [""] * size, [None] * size
        ends = np.zeros(size, bool)
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        for name, i in vocab.items():
            names[i] = name
            ends[i] = name.endswith(suffix)
            forms[i] = bytes(byte_of[c] for c in name.removesuffix(suffix))
        for name, i in special.items():
            names[i] = name
        left, right, rank = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for r, (a, b) in enumerate(told["model"]["merges"]):
            i = vocab[a + b]
            left[i], right[i], rank[i] = vocab[a], vocab[b], r
        split = next(p for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        made = cls(names, forms, ends, left, right, rank, special, [(below, word_pattern(split, below)) for below in (0x80, 0x250, 0x10000, 0x110000)])
        made._verify_tokens()
        return made

    def _verify_tokens(self) -> None:
        made = np.flatnonzero(self.rank >= 0)
        keys = self.left[made] * len(self.names) + self.right[made]
        order = np.argsort(keys)
        self.merge_keys, self.merge_token = keys[order], made[order]
        if not (self.rank[made] > np.maximum(self.rank[self.left[made]], self.rank[self.right[made]])).all():
            raise ValueError("a merge comes before one it is made of; pair checks would not be exact")
        self._edges()
        self.sound = np.array([f is not None for f in self.forms])
        joins = self.compatible(self.left[made], self.right[made], own=made)
        for token, fine in sorted(zip(made, joins), key=lambda x: self.rank[x[0]]):
            self.sound[token] = fine and self.sound[self.left[token]] and self.sound[self.right[token]]

    def _edges(self) -> None:
        """For each token the nodes on the right and left edge of its merge tree, and the rank at which each one is merged away."""
        size = len(self.names)

        def edge(child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nodes, until = [np.arange(size)], [np.full(size, NEVER)]
            while (nodes[-1] >= 0).any():
                node = nodes[-1]
                until.append(np.where(node >= 0, self.rank[node], 0))
                nodes.append(np.where(node >= 0, child[node], -1))
            return np.stack(nodes, 1), np.stack(until, 1)

        self.right_edge, self.right_until = edge(self.right)
        self.left_edge, self.left_until = edge(self.left)
        self.can_start, self.can_end = np.zeros(size, bool), np.zeros(size, bool)
        self.can_start[self.merge_keys // size] = True
        self.can_end[self.merge_keys % size] = True
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self._spot(self.merge_keys // size, self.merge_keys % size)] = True

    @staticmethod
    def _spot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40_503 + b * 2_654_435 + (b >> 3)) & ((1 << 20) - 1)

    def compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether each border between a and b stays a border. ``own``: their own merge, which does not count."""
        fine, size = np.ones(len(a), bool), len(self.names)
        for i in range(self.right_edge.shape[1]):
            x = self.right_edge[a, i]
            rows = np.flatnonzero((x >= 0) & self.can_start[x])
            for j in range(self.left_edge.shape[1]):
                if not len(rows):
                    break
                y = self.left_edge[b[rows], j]
                near = np.flatnonzero((y >= 0) & self.can_end[y] & self.sieve[self._spot(x[rows], y)])
                at = rows[near]
                keys = x[at] * size + y[near]
                found = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
                hit = self.merge_keys[found] == keys
                at, token = at[hit], self.merge_token[found[hit]]
                rank = self.rank[token]
                breaks = (rank < self.right_until[a[at], i]) & (rank <= self.left_until[b[at], j])
                if own is not None:
                    breaks &= token != own[at]
                fine[at[breaks]] = False
        return fine


class Encoder:
    """Encodes texts of one task, with a table of the words seen so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.finders = [(re.compile(f"[{chr(below)}-\U0010ffff]").search if below <= sys.maxunicode else lambda text: None, re.compile(pattern).findall) for below, pattern in vocabulary.patterns]
        self.find_later = re.compile("[" + "".join(map(chr, LATER_LOWER)) + "]").search
        self.find_special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.marks = tuple(vocabulary.special)
        self.automaton = ahocorasick.Automaton()
        self.base = [{}, {}]
        for i, form in enumerate(vocabulary.forms):
            if form is not None:
                if len(form) == 1:
                    self.base[int(vocabulary.ends[i])][form[0]] = i
                if vocabulary.sound[i]:
                    self.automaton.add_word(form.decode("latin-1") + "Ā" * bool(vocabulary.ends[i]), (i, len(form) + bool(vocabulary.ends[i])))
        self.automaton.make_automaton()
        self.merges = {int(k): int(t) for k, t in zip(vocabulary.merge_keys, vocabulary.merge_token)}
        self.rank_of = {k: int(vocabulary.rank[t]) for k, t in self.merges.items()}
        self.pair_codes, self.pair_fine = np.zeros(0, np.int64), np.zeros(0, bool)
        self.exact_words = 0
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost of equal ranks, until nothing merges."""
        symbols = [self.base[0][b] for b in word[:-1]] + [self.base[1][word[-1]]]
        return self._merge_short(symbols) if len(symbols) <= 48 else self._merge_long(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        size, rank_of = len(self.v.names), self.rank_of
        ranks = [rank_of.get(a * size + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while ranks and (lowest := min(ranks)) != NEVER:
            i = ranks.index(lowest)
            symbols[i] = self.merges[symbols[i] * size + symbols[i + 1]]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of.get(symbols[i] * size + symbols[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank_of.get(symbols[i - 1] * size + symbols[i], NEVER)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same over a heap and linked symbols, for words of any length."""
        size, rank, merges = len(self.v.names), self.v.rank, self.merges
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        waiting = [(rank[t], i, t) for i in range(len(symbols) - 1) if (t := merges.get(symbols[i] * size + symbols[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, token = heapq.heappop(waiting)
            if symbols[i] < 0 or (j := after[i]) < 0 or merges.get(symbols[i] * size + symbols[j]) != token:
                continue
            symbols[i], symbols[j], after[i] = token, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (t := merges.get(symbols[k] * size + symbols[after[k]])) is not None:
                    heapq.heappush(waiting, (rank[t], k, t))
        return [s for s in symbols if s >= 0]

    def _fine(self, codes: np.ndarray) -> np.ndarray:
        """Pair checks, each distinct pair once for a task (emptied with the words)."""
        distinct, back = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair_codes, distinct), max(len(self.pair_codes) - 1, 0))
        known = self.pair_codes[at] == distinct if len(self.pair_codes) else np.zeros(len(distinct), bool)
        fine = np.zeros(len(distinct), bool)
        fine[known] = self.pair_fine[at[known]] if known.any() else False
        new = distinct[~known]
        if len(new):
            size = len(self.v.names)
            fine[~known] = checked = self.v.compatible(new // size, new % size)
            merged = np.concatenate([self.pair_codes, new])
            order = np.argsort(merged, kind="stable")
            self.pair_codes, self.pair_fine = merged[order], np.concatenate([self.pair_fine, checked])[order]
        return fine[back]

    def _resolve(self, words: list[str]) -> None:
        """Tokens of words not seen before, appended to the table."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        text = "Ā".join(r.decode("latin-1") for r in raw) + "Ā"
        last = np.cumsum(sizes + 1) - 1  # where each word's end mark stands
        proposed = [(end, token, width) for end, (token, width) in self.automaton.iter_long(text)]
        end, token, width = np.array(proposed, np.int64).reshape(-1, 3).T
        word = np.searchsorted(last, end)
        failed = np.bincount(word, width, len(raw)) != sizes + 1  # a byte or an end mark is not covered
        pair = np.flatnonzero(word[1:] == word[:-1])
        if len(pair):
            failed[word[pair[~self._fine(token[pair] * len(self.v.names) + token[pair + 1])]]] = True
        keep = ~failed[word]
        token, word = token[keep], word[keep]
        exact = [(i, self.merge_exactly(raw[i])) for i in np.flatnonzero(failed)]
        self.exact_words += len(exact)
        if exact:
            token = np.concatenate([token, np.concatenate([np.array(t, np.int64) for _, t in exact])])
            word = np.concatenate([word, np.repeat([i for i, _ in exact], [len(t) for _, t in exact])])
            order = np.argsort(word, kind="stable")
            token, word = token[order], word[order]
        count = np.bincount(word, minlength=len(raw))
        while self.used + len(token) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(raw) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(token)] = token
        self.start[self.known : self.known + len(raw)] = self.used + np.cumsum(count) - count
        self.size[self.known : self.known + len(raw)] = count
        self.used, self.known = self.used + len(token), self.known + len(raw)

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a capital sigma is lowered without looking at its place
            if self.find_later(text):
                text = text.translate(LATER_LOWER)
        return text.lower()

    def _words(self, text: str) -> list[str]:
        text = self._normal(text)
        return next(find for beyond, find in self.finders if not beyond(text))(text)

    def _pieces(self, text: str) -> list[str]:
        """Words in order; a special token stands as its id behind a null character, which no word holds beside letters."""
        if self.find_special is None or not any(m in text for m in self.marks):
            return self._words(text)
        found: list[str] = []
        for part in self.find_special.split(text):
            found.extend([f"\x00{self.v.special[part]}\x00"] if part in self.v.special else self._words(part))
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text, as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        block: list[np.ndarray] = []
        new: list[str] = []
        chars = 0
        for n, text in enumerate(texts):
            if len(self.index) > WORD_LIMIT and not block:
                self._clear()
                self.pair_codes, self.pair_fine = self.pair_codes[:0], self.pair_fine[:0]
            index = self.index
            words = self._pieces(text) if text else []
            try:
                block.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            except KeyError:
                for w in words:
                    if w not in index:
                        index[w] = len(index)
                        new.append(w)
                block.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
            chars += len(text or "")
            if chars >= BLOCK_CHARS or n == len(texts) - 1:
                if new:
                    self._resolve_all(new)
                out.extend(map(self._gather, block))
                block, new, chars = [], [], 0
        return out

    def _resolve_all(self, words: list[str]) -> None:
        special = [i for i, w in enumerate(words) if len(w) > 2 and w[0] == "\x00" and w[-1] == "\x00" and w[1:-1].isdecimal()]
        if not special:
            return self._resolve(words)
        first = 0
        for i in [*special, len(words)]:
            if words[first:i]:
                self._resolve(words[first:i])
            if i < len(words):
                if self.used + 1 > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                if self.known + 1 > len(self.start):
                    self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
                self.flat[self.used], self.start[self.known], self.size[self.known] = int(words[i][1:-1]), self.used, 1
                self.used, self.known = self.used + 1, self.known + 1
            first = i + 1

    def _gather(self, index: np.ndarray) -> np.ndarray:
        count = self.size[index]
        stop = np.cumsum(count)
        return self.flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.start[index] - stop + count, count)]


class Decoder:
    """Token names joined by one space, as a vocabulary without a decoder of its own is decoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.names = [n.encode() for n in vocabulary.names]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and int(ids.max()) >= len(self.names):
            ids = ids[ids < len(self.names)]
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


def add_token_ids(documents: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All columns, and the token ids of a text column."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary)
        for texts in batches:
            for first in range(0, len(texts), SLICE_ROWS):
                yield pd.Series([i.astype(np.int32) for i in encoder.encode(texts.iloc[first : first + SLICE_ROWS].tolist())], dtype=object)

    return documents.withColumn(ids, encode(text))


def add_decoded_text(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", text: str = "decoded_text") -> DataFrame:
    """All columns, and the text that the ids stand for."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(vocabulary)
        for rows in batches:
            yield pd.Series(["" if r is None else decoder.decode(np.array([i for i in r if i is not None and i >= 0], np.int64)).decode() for r in rows], dtype=object)

    return encoded.withColumn(text, decode(ids))


def add_ids_and_decoded(documents: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text") -> DataFrame:
    """All columns, the token ids, and the text decoded from these ids, in one Python step."""

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for texts in batches:
            for first in range(0, len(texts), SLICE_ROWS):
                found = encoder.encode(texts.iloc[first : first + SLICE_ROWS].tolist())
                yield pd.DataFrame({"ids": [i.astype(np.int32) for i in found], "decoded": [decoder.decode(i).decode() for i in found]})

    hidden = "__bpe"
    return documents.withColumn(hidden, both(text)).withColumn(ids, F.col(f"{hidden}.ids")).withColumn(decoded, F.col(f"{hidden}.decoded")).drop(hidden)


def token_digests(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the text decoded from these ids."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for texts in batches:
            rows = []
            for first in range(0, len(texts), SLICE_ROWS):
                for ids in encoder.encode(texts.iloc[first : first + SLICE_ROWS].tolist()):
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", digest("text").alias("found")).select("doc_id", "found.*")
