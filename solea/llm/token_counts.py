"""Token counts without token ids: pieces are counted once for each distinct pre-token and joined to the documents' pre-token frequencies.

A pre-token is a stretch of a text that no piece of the vocabulary can cross, so the tokens of a text are those of its pre-tokens. Two kinds of borders
are used, and both are proved against the vocabulary when it is read: before each run of spaces, and, if no piece joins them, between ASCII letters and
the ASCII characters that are neither letters nor spaces. Both are found on the bytes of a block of texts at once.

A block of texts (whole texts, about ``BLOCK_BYTES``) becomes a dictionary of its pre-tokens and a frequency table (document, pre-token, n). Pieces are counted for the entries of the
dictionary that the task has not met yet, joined to the frequencies by dictionary code, and summed for each document. The join stays inside the
block on purpose: a frequency row is hardly smaller than the words it stands for, so a shuffle by pre-token would move more bytes than the corpus
has, and a hot pre-token such as an article would meet in one task. One pass, no shuffle, nothing collected; a lost executor repeats its own
blocks only. The table of pre-tokens met is emptied at ``WORD_LIMIT`` entries, which changes no result; long pre-tokens are never kept in it.

The model file is read on the driver and travels as bytes; executors need no file.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings in a text are ordinary text; texts of any length are counted whole (a longer one is a
block of its own); repeated rows are counted row by row; an empty table gives an empty result; other columns, whatever their names, are kept by
``add_token_counts`` except one that has the name of the result, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
WORD_LIMIT = 300_000
KEPT_BYTES = 64
SPACE = "▁"  # stands for a space in the vocabulary
# kinds of bytes: every byte of a longer character is 0 and makes no border
_LETTER, _OTHER, _BLANK = 1, 2, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[:128] = _OTHER
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[32] = _BLANK
_JOINED = re.compile(r"[A-Za-z][\x00-\x1f!-@\[-`{-\x7f]|[\x00-\x1f!-@\[-`{-\x7f][A-Za-z]")


@dataclass(frozen=True)
class PieceModel:
    """A BPE model of pieces: its bytes with the leading space left to the caller, and whether letters and other ASCII characters never share a piece."""

    raw: bytes
    letters_apart: bool

    @classmethod
    def read(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        model.ParseFromString(Path(path).read_bytes())
        rules, kinds = model.normalizer_spec, formats.ModelProto.SentencePiece
        plain = rules.name == "identity" and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        pieces = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        whole = all(p.type in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) for p in model.pieces)
        if model.trainer_spec.model_type != formats.TrainerSpec.BPE or not plain or not whole or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError(f"{path}: pre-tokens are only proved for BPE models with identity normalisation and spaces at the front of pieces")
        rules.add_dummy_prefix = False
        return cls(model.SerializeToString(), not any(_JOINED.search(p) for p in pieces))


def pre_tokens(texts: pa.Array, letters_apart: bool) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts as one array over their bytes, and the position of each one's text."""
    text = pa.large_string()
    texts = pc.replace_substring(pc.fill_null(texts.cast(text), ""), SPACE, " ")
    front = pc.if_else(pc.equal(texts, ""), pa.scalar("", text), pa.scalar(" ", text))  # a text that has anything is led by one space
    joined = pc.binary_join_element_wise(front, texts, pa.scalar("", text))
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    first = ends[:-1] - ends[0]
    kind = _KINDS[raw]
    border = kind == _BLANK
    border[1:] &= kind[:-1] != _BLANK
    if letters_apart:
        border[1:] |= kind[1:] + kind[:-1] == _LETTER + _OTHER
    border[first[np.diff(ends) > 0]] = True
    at = np.flatnonzero(border)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
    return words, np.searchsorted(first, at, side="right") - 1


class PieceCounter:
    """Numbers of pieces; each distinct pre-token is counted when it is first met."""

    def __init__(self, model: PieceModel):
        self.letters_apart = model.letters_apart
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.raw)
        self.known: dict[bytes, int] = {}

    def pieces(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each of the distinct ``words``."""
        if len(self.known) > WORD_LIMIT:
            self.known = {}
        new = [w for w in words if w not in self.known]
        counted = dict(zip(new, map(len, self.library.encode([w.decode() for w in new], num_threads=1))))
        found = np.fromiter((counted[w] if w in counted else self.known[w] for w in words), np.int64, len(words))
        self.known.update((w, n) for w, n in counted.items() if len(w) <= KEPT_BYTES)
        return found

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        words, text = pre_tokens(texts, self.letters_apart)
        coded = words.dictionary_encode()
        one = pa.table({"text": text, "word": coded.indices}).group_by(["text", "word"], use_threads=False)
        frequency = one.aggregate([([], "count_all")])
        pieces = pa.array(self.pieces(coded.dictionary.to_pylist()))
        tokens = pc.multiply(frequency["count_all"], pc.take(pieces, frequency["word"]))
        summed = pa.table({"text": frequency["text"], "tokens": tokens}).group_by("text", use_threads=False).aggregate([("tokens", "sum")])
        total = np.zeros(len(texts), np.int64)
        total[summed["text"].to_numpy()] = summed["tokens_sum"].to_numpy()
        return total


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """The texts in order, cut between rows so that a block holds about ``limit`` bytes; a longer text is a block of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def token_count(model: PieceModel, text: Column | str = "text") -> Column:
    """Number of tokens of a text column, as an expression."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(model)
        for batch in batches:
            parts = [counter.count(block) for block in blocks(batch)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return count(text)


def add_token_counts(documents: DataFrame, model: PieceModel, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """All columns, and the number of tokens."""
    return documents.withColumn(name, token_count(model, text))


def count_tokens(documents: DataFrame, model: PieceModel, limit: int = 4096) -> DataFrame:
    """doc_id, bytes and tokens of each document, and whether it has more than ``limit`` tokens."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return documents.select("doc_id", size, token_count(model).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
