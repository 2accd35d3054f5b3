"""Token counts against the library, divergences against plain integers and SQL, hard negatives against all pairs."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import public_tokenizers
from solea.llm import divergence, hard_negatives, token_counts
from solea.llm.queries import ORACLES, QUERIES
from tests.compare import connect, _norm, _rows
from tests.llm.conftest import DATA

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_token_counts_equal_the_library(documents, library):
    model = token_counts.PieceModel.read(PATH)
    rows = token_counts.add_token_counts(documents, model).collect()
    assert len(rows) == documents.count() and set(documents.columns) < set(rows[0].asDict())
    assert [r["n_tokens"] for r in rows] == [len(library.encode(r["text"] or "")) for r in rows]


def test_token_counts_of_odd_rows(odd, nothing, library):
    model = token_counts.PieceModel.read(PATH)
    rows = token_counts.count_tokens(odd.withColumn("n_tokens", F.lit("mine")).withColumn("n_bytes", F.lit(1)), model).collect()
    texts = odd.collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == sorted(
        (str(t["doc_id"]), len((t["text"] or "").encode()), n := len(library.encode(t["text"] or "")), n > 4096) for t in texts)
    assert token_counts.count_tokens(nothing, model).count() == 0


def test_pre_tokens_do_not_change_counts(library, monkeypatch):
    random = np.random.default_rng(3)
    letters = list(" ▁ab\n\t.,01é—“漢ﬁ\x00\x01<s>'-Z") + ["<s>", "</s>", "<unk>", "the", " the", "  "]
    texts = ["", None, " ", "  ", "▁", "a" * 3000] + ["".join(random.choice(letters, random.integers(0, 40))) for _ in range(3000)]
    want = [len(library.encode(t or "")) for t in texts]
    model = token_counts.PieceModel.read(PATH)
    for pieces in (model, token_counts.PieceModel(model.raw, False)):
        assert token_counts.PieceCounter(pieces).count(pa.array(texts)).tolist() == want
    monkeypatch.setattr(token_counts, "WORD_LIMIT", 10)
    counter = token_counts.PieceCounter(model)
    assert [n for block in token_counts.blocks(pa.array(texts), 100) for n in counter.count(block)] == want


def test_blocks_keep_every_row():
    texts = pa.array(["a" * n for n in (5, 0, 100, 3, 3, 3, 50)] + [None])
    parts = list(token_counts.blocks(texts, 10))
    assert pa.concat_arrays(parts).equals(texts) and max(len(p) for p in parts) > 1 and list(token_counts.blocks(pa.array([], pa.string()))) == []


def plain_divergence(rows, least, top, scale):
    """The definition, with Python integers."""
    found, docs, groups = {}, Counter(), set()
    for text, lang, source in rows:
        words = [w for w in re.split("[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        group = (lang or "", source or "")
        groups.add(group)
        found.setdefault(group, Counter()).update(words)
        docs.update((group[0], w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (at, w), n in docs.items() if at == lang and n >= least]
        own = {s: found[lang, s] for at, s in groups if at == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)

        def p(counts):
            total = sum(counts[w] for w in kept) + len(kept)
            return {w: 1 + scale * (counts[w] + 1) // total for w in kept}

        of, q = {s: p(c) for s, c in own.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted(((sum(f(of[s][w], of[o][w]) for w in kept), o) for o in own if o != s), key=lambda r: (-r[0], r[1].encode()))
            terms = sorted(((f(of[s][w], q[w]), w) for w in kept if own[s][w] and of[s][w] > q[w]), key=lambda r: (-r[0], r[1].encode()))[:top]
            out += [(lang, s, part, item, value, rank) for part, rows in (("pair", pairs), ("term", terms)) for rank, (value, item) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells, block", [(divergence.SHARD_CELLS, 8 << 20), (50, 2000)])
def test_divergence_equals_plain_integers(spark, documents, odd, monkeypatch, cells, block):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    monkeypatch.setattr(divergence, "blocks", lambda texts: token_counts.blocks(texts, block))
    few = documents.limit(60).select("text", "lang", "source").union(odd.select("text", "lang", "source")).union(
        spark.createDataFrame([("Ünïcode ÉTÉ été_x a\x00b", "xx", "one"), ("", "xx", "two"), ("ünïcode", "xx", "two"), ("...", "yy", "one")], "text string, lang string, source string"))
    rows = [tuple(r) for r in few.collect()]
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.source_divergence(few, least_documents=2, top=7).collect())
    assert got == plain_divergence(rows, 2, 7, 10**9)


def test_divergence_of_nothing(nothing):
    assert divergence.source_divergence(nothing).count() == 0


def test_long_division_is_exact():
    count, total = np.array([0, 5, 10**12, 8 * 10**15], np.int64), np.array([1, 7, 3 * 10**13, 9 * 10**15], np.int64)
    assert divergence._probabilities(count, total, 10**9).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total)]


@pytest.mark.parametrize("name", ["op12_divergence", "op13_hard_negatives"])
def test_query_agrees_with_sql(spark, name):
    con = connect(DATA)
    result = con.execute(ORACLES[name])
    want = _norm(pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description], dtype=object))
    got = _norm(_rows(QUERIES[name](spark, DATA)))
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0 and (got == want).all().all()


def plain_negatives(rows):
    """All anchors against all rows, with Python integers."""
    fit = [(i, [int(np.floor(256.0 * float(x))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, v, own in (r for r in fit if r[0] % 50 == 0):
        score = sorted(((sum(x * y for x, y in zip(v, w)), i, lab) for i, w, lab in fit if i != a), key=lambda r: (-r[0], r[1]))
        for s, i, _ in [r for r in score if r[2] == own][:5]:
            near = [r for r in score if r[2] != own and 50 * s <= 100 * r[0] <= 95 * s][:3]
            out += [(a, i, rank, n, s, t) for rank, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def labelled(spark):
    """Clusters, many equal vectors, ties, repeated ids, rows that take no part, and clashing names."""
    random = np.random.default_rng(7)
    centres = random.normal(size=(6, 16)) * 2
    rows = [(k, (centres[k % 6] + random.normal(size=16) * 0.4).astype(np.float32).tolist(), int(random.integers(0, 3))) for k in range(400)]
    rows += [(1000 + k, centres[1].astype(np.float32).tolist(), k % 4) for k in range(160)] + [(7, [0.5] * 16, 1), (50, [1.0] * 16, 2), (1050, [0.0] * 16, 0)]
    rows += [(2000, None, 1), (2050, [float("nan")] * 16, 1), (2100, [None] + [1.0] * 15, 1), (2150, [float("inf")] + [1.0] * 15, 1), (2200, [1.0] * 16, None), (None, [1.0] * 16, 1),
             (2250, [], 1), (2300, [3.0] * 8, 0), (2350, [-1.0] * 16, 8), (2351, [-1.0] * 16, 8)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("v", F.lit(3))


@pytest.mark.parametrize("shard, block, first", [(2048, 2048, 1024), (40, 10, 30)])
def test_negatives_equal_all_pairs(labelled, monkeypatch, shard, block, first):
    for name, value in (("SHARD_ROWS", shard), ("BLOCK_ROWS", block), ("FIRST_ROWS", first)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows, df = labelled
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, words=8).collect())
    assert got == plain_negatives(rows) and len(got) > 50


def test_negatives_of_few_or_no_rows(labelled):
    _, df = labelled
    for few in ("false", "vec_id = 50", "vec_id IN (2350, 2351)", "vec_id >= 2000", "vec_id IN (2250, 2300)"):
        assert hard_negatives.hard_negatives(df.where(few), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(k, [float(2**22 + k), float(3 * k + 1)], k % 2) for k in range(0, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wide = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, low=10, high=100).collect())
    score = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(rows[a][1], rows[b][1]))
    assert wide and all(r[4] == score(r[0], r[1]) and r[5] == score(r[0], r[3]) for r in wide)


def test_cells_are_walked_in_falling_order():
    random = np.random.default_rng(2)
    a, b = random.normal(size=9), random.normal(size=7)
    a[3] = -np.inf
    walked = list(hard_negatives.walk(a, b))
    assert [x for x, _, _ in walked] == sorted((float(p + q) for p in a for q in b if np.isfinite(p)), reverse=True) and len({(i, j) for _, i, j in walked}) == 8 * 7
