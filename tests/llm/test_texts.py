"""Operators on texts against brute force on small tables."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solea.llm import bpe, html_text, jaccard, mixing, pii, pseudo_likelihood, quality, repeats
from tests.llm.conftest import DATA


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# BPE

def hard_texts():
    random = np.random.default_rng(1)
    letters = list("abcdefgé'0 ") + ["the", "ing", "er", "an"]
    made = ["".join(random.choice(letters, random.integers(1, 60))) for _ in range(3000)]
    return made + ["aaaa" * 50, "ab" * 3000, "it's we'll I'M", "<|startoftext|>Hi <|endoftext|><|startoftext|", "ΑΣ Σ ΟΔΥΣΣΕΥΣ İ ǅ", "\x0049406\x00 a\x85b", "é é", "", None, "e" * 200]


def test_encoding_equals_the_library(vocabulary, library):
    texts = hard_texts()
    encoder = bpe.Encoder(vocabulary)
    found = encoder.encode(texts)
    assert [f.tolist() for f in found] == [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert 0 < encoder.exact_words < len(encoder.index)
    decoder = bpe.Decoder(vocabulary)
    assert [decoder.decode(f).decode() for f in found] == [library.decode(f.tolist(), skip_special_tokens=False) for f in found]


def test_every_character_is_split_and_lowered_alike(vocabulary, library):
    texts = [f"a{chr(c)}a {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    assert [f.tolist() for f in bpe.Encoder(vocabulary).encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_word_table_may_be_emptied_at_any_time(vocabulary, monkeypatch):
    texts = hard_texts()
    whole = bpe.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(bpe, "WORD_LIMIT", 50)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 300)
    assert all((a == b).all() for a, b in zip(whole, bpe.Encoder(vocabulary).encode(texts)))


def test_bpe_on_tables(vocabulary, library, odd, nothing, documents):
    both = bpe.add_ids_and_decoded(odd, vocabulary)
    apart = bpe.add_decoded_text(bpe.add_token_ids(odd, vocabulary), vocabulary)
    assert both.columns == [*odd.columns, "token_ids", "decoded_text"]
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))
    digests = as_dict(bpe.token_digests(documents, vocabulary))
    for r in documents.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        told = digests[r["doc_id"]]
        assert told["n_tokens"] == len(ids) and told["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert told["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digests(nothing, vocabulary).count() == 0


# n-gram Jaccard join

def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_similar_classes_against_all_pairs(spark, documents, width, percent):
    base = [f"w{k}" for k in range(60)]
    made = [(10_000 + k, " ".join(base[:k] + ["new"] * (k % 3) + base[k:])) for k in range(60)] + [(20_000 + k, " ".join(base[k:])) for k in range(20)]
    made += [(30_000, "Short One"), (30_001, "short one"), (30_002, "one"), (30_003, None), (30_004, " \n")]
    all_rows = documents.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_classes(all_rows, width, percent).collect()}
    assert found == brute_components([(r["doc_id"], r["text"]) for r in all_rows.collect()], width, percent)


def test_similar_classes_odd_rows(odd, nothing):
    found = jaccard.similar_classes(odd, 3, 90).collect()
    assert len(found) == odd.count() and {r["component_id"] for r in found if r["doc_id"] in (3, 4)} == {3}
    assert jaccard.similar_classes(nothing, 3, 90).count() == 0


def test_sketches_never_differ_more_than_sets():
    random = np.random.default_rng(2)
    for _ in range(200):
        tokens = np.unique(random.integers(0, 1 << 63, 300, dtype=np.uint64))
        a, b = tokens[random.random(len(tokens)) < 0.9], tokens[random.random(len(tokens)) < 0.8]
        differ = sum(int(x).bit_count() for x in (jaccard.parity_sketch(a) ^ jaccard.parity_sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


# Repeated strings

def brute_repeats(texts, length):
    met = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if met[t[i : i + length]] > 1:
                covered[i : i + length] = True
        out.append((len(t), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~covered])))
    return out


@pytest.mark.parametrize("group_rows", [4096, 1])
def test_repeats_against_all_strings(spark, monkeypatch, group_rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    random = np.random.default_rng(4)
    passage = "".join(random.choice(list("abcd é"), 500))
    texts = [passage[a : a + n] + "".join(random.choice(list("xyz"), m)) + passage[b : b + k] for a, n, m, b, k in random.integers(0, 260, (60, 5))]
    texts += [None, "", "x" * 700, "ab" * 250, passage, passage, "q" + passage, "é" * 150, "1" + "é" * 140, "short"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(rows).collect()}
    assert [found[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts], 200)


@pytest.mark.parametrize(("group_rows", "broadcast_rows"), [(4096, 1_000_000), (4096, 0), (2, 0)])
def test_segments_are_not_shuffled_to_find_their_groups(spark, monkeypatch, group_rows, broadcast_rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", broadcast_rows)
    plans, stored = {}, repeats.store
    monkeypatch.setattr(repeats, "store", lambda df, label="state": plans.__setitem__(label, df._jdf.queryExecution().executedPlan().toString()) or stored(df, label))
    random = np.random.default_rng(6)
    passage = "".join(random.choice(list("abcd"), 420))
    texts = [passage[a:] + "".join(random.choice(list("xyz"), m)) + passage[: 420 - b] for a, m, b in random.integers(0, 200, (30, 3))] + [passage, passage, "y" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables above it
    try:
        found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [found[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 200)
    assert broadcast_rows == 0 or plans["runs"].count("SortMergeJoin") == 1  # counted strings only


def test_spans_are_merged_to_maximal_runs(spark):
    random = np.random.default_rng(8)
    made = [[(int(a), int(a + n)) for a, n in zip(random.integers(0, 3000, k), random.integers(1, 60, k))] for k in (1, 2, 40, 300, 5)]
    rows = spark.createDataFrame(list(enumerate(made)), "id int, spans array<struct<first:int,end:int>>")
    found = dict(tuple(r) for r in rows.select("id", repeats._merged(F.col("spans"))).collect())
    for i, spans in enumerate(made):
        covered = np.zeros(4000, bool)
        for a, b in spans:
            covered[a:b] = True
        edge = {a for a, _ in spans}
        runs = [(x["first"], x["end"]) for x in found[i]]
        assert {p for a, b in runs for p in range(a, b)} == set(np.flatnonzero(covered)) and all(b < c for (_, b), (c, _) in zip(runs, runs[1:])) and {a for a, _ in runs} <= edge
    assert rows.where("false").select(repeats._merged(F.col("spans"))).count() == 0


@pytest.mark.parametrize("early", [1, 8])
def test_pairs_are_left_out_of_later_lists_only(spark, monkeypatch, early):
    """The last step alone finds every link, however few early tokens are carried."""
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "EARLY", early)
    random = np.random.default_rng(9)
    base = [[f"w{k}" for k in random.integers(0, 400, n)] for n in (30, 80, 200)]
    made = []
    for words in base:
        for _ in range(25):
            keep = random.random(len(words)) < random.choice([0.97, 0.99, 1.0])
            made.append(" ".join(w for w, k in zip(words, keep) if k))
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_classes(rows, 5, 80).collect()}
    assert found == brute_components(list(enumerate(made)), 5, 80)


def test_repeats_odd_rows(odd, nothing):
    assert repeats.repeat_digests(odd).count() == odd.count() and repeats.repeat_digests(nothing).count() == 0


def test_long_texts_are_cut_in_overlapping_pieces(monkeypatch):
    raw = bytes(np.random.default_rng(5).integers(97, 123, 5000, dtype=np.uint8))
    whole = repeats.Elector(200, 64).elect(raw)
    monkeypatch.setattr(repeats, "PIECE", 700)
    pieces = repeats.Elector(200, 64).elect(raw)
    starts = lambda rows: {s: p for _, p, low, high in rows for s in range(low, high + 1)}
    assert starts(whole) == starts(pieces) and len(starts(whole)) == 4801


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_base_spans_against_plain_patterns(spark, documents, odd):
    random = np.random.default_rng(6)
    parts = ["a", "b.", "@", "1", "23", "4", "+", "-", " ", ".", "(", ")", "x@y.z", "1.2.3.4", "é", "😀", "4111 1111 1111 1111", "+1 (443) 555-5793", "_"]
    made = [(10_000 + i, "".join(random.choice(parts, random.integers(0, 40)))) for i in range(1500)] + [(20_000, "a" * 100_000), (20_001, "1" * 100_000), (20_002, "256.1.1.1 000001.2.3.4")]
    rows = documents.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).union(odd.select("doc_id", "text"))
    found = [(r["text"], r["base"]) for r in pii.find_personal_data(rows.withColumn("doc_id", rows["text"])).select("doc_id", "base_sha256").toDF("text", "base").collect()]
    assert len(found) == rows.count() and all(hashlib.sha256(brute_spans(t).encode()).hexdigest() == base for t, base in found)


def test_labelers_add_written_out_data_and_leave_versions_alone(spark):
    rows = spark.createDataFrame([(1, "please call (443) 555-5793 or mail bob (at) example (dot) com"), (2, "version 1.2.3 build 2024 of order 12-34")] + [(k, f"mail a{k}@b.com phone +1 (443) 555-57{k}") for k in range(10, 40)], "doc_id long, text string")
    found = as_dict(pii.find_personal_data(rows))
    assert found[1]["n_phone"] == 1 and found[1]["n_email"] == 1 and found[2]["spans"] == ""
    hidden = as_dict(pii.redact(rows))
    assert hidden[1]["text"] == "please call [PHONE] or mail [EMAIL]" and hidden[2]["text"] == "version 1.2.3 build 2024 of order 12-34"


def test_redaction_keeps_columns(odd, nothing, documents):
    assert pii.redact(documents).columns == documents.columns and pii.redact(odd).count() == odd.count()
    assert pii.redact(nothing).count() == 0 and pii.find_personal_data(nothing).count() == 0


# Mixing

def test_mix_deviates_less_than_a_block(spark):
    sizes = {"big": 4000, "a": 900, "b": 500, None: 300}
    rows = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    weights = {"big": 5, "a": 3, "b": 1.5, None: 0.5}
    placed = mixing.mix_order(rows, weights=weights, block_rows=8, frame=20).collect()
    assert len({r["position"] for r in placed}) == len(placed) == sum(sizes.values())
    order = [s for _, s in sorted({(r["slot"], r["source"] or "") for r in placed})]
    assert len(order) == len({r["slot"] for r in placed}) == max(r["slot"] for r in placed) + 1
    first = min(-(-n // 8) / weights[s] for s, n in sizes.items())  # until the first source runs out
    had = Counter()
    for t, s in enumerate(order[: int(first * 10) - 20], 1):
        had[s] += 1
        assert all(abs(had[name or ""] - w / 10 * t) < 1 for name, w in weights.items())


def test_frames_meet_all_windows():
    parts = {"x": 7, "y": 11, "z": 1}
    for source, k, slot in mixing.frame_schedule(parts):
        assert k * 19 // parts[source] <= slot < -(-(k + 1) * 19 // parts[source])


def test_weights_are_not_rounded():
    for weights in ({"a": 1, "b": 2}, {"a": 0.001, "b": 0.4, "c": 0.599}, {"a": 10**0.7, "b": 7**0.7, "c": 90**0.7}):
        exact = mixing.target_weights(dict.fromkeys(weights, 1), weights, 0.7, 200)
        total, had = sum(exact.values()), Counter()
        for source, k, slot in mixing.slots({s: int(w / total * 6000) + 2 for s, w in exact.items()}, exact):
            assert k == had[source]
            had[source] += 1
            if slot < 5900:  # no source has run out
                assert all(abs(had[s] - w / total * (slot + 1)) < 1 for s, w in exact.items())


def largest_deviation(order, blocks, weights):
    """From the fluid mix, after every slot of an order of sources."""
    had, fluid, worst = Counter(), dict.fromkeys(blocks, Fraction(0)), 0
    for source in order:
        had[source] += 1
        left = Fraction(1)
        while left:  # one slot is shared by weight; who has all its blocks leaves its part to the others
            active = [s for s in blocks if fluid[s] < blocks[s]]
            total = sum(weights[s] for s in active)
            step = min(left, *((blocks[s] - fluid[s]) * total / weights[s] for s in active))
            for s in active:
                fluid[s] += step * weights[s] / total
            left -= step
        worst = max(worst, *(abs(had[s] - fluid[s]) for s in blocks))
    return worst


def test_mix_goes_on_exactly_when_sources_run_out():
    blocks, weights = {"a": 5, "b": 400, "c": 37, "d": 1, "e": 90}, {"a": Fraction(1, 3), "b": 2, "c": 5, "d": Fraction(1, 7), "e": 1}
    order = list(mixing.slots(blocks, weights))
    assert [slot for _, _, slot in order] == list(range(533)) and len({(s, k) for s, k, _ in order}) == 533
    assert largest_deviation([s for s, _, _ in order], blocks, weights) < 1


def test_mix_of_many_sources(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('host', id % 700) AS source")
    placed = mixing.mix_order(rows).collect()
    assert sorted(r["doc_id"] for r in placed) == list(range(3000)) and {r["slot"] for r in placed} == set(range(700))


def test_mix_odd_rows(odd, nothing, documents):
    assert mixing.mixed(documents).columns == documents.columns
    assert sorted(map(str, mixing.mixed(odd).collect())) == sorted(map(str, odd.collect())) and mixing.mixed(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_order(documents, max_sources=2)


# Quality

def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.score_quality(docs, labels).collect() if r["doc_id"] in known]
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 50 and np.mean([r["predicted"] == known[r["doc_id"]] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_never_sees_held_out_labels_or_other_columns(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    plain = documents.select("doc_id", "text")
    assert as_dict(quality.score_quality(documents, labels)) == as_dict(quality.score_quality(plain, turned))


def test_trees_split_and_flat_walk_agree():
    x = np.random.default_rng(7).normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit_trees(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    one, total = x[:1], trees.start
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if one[0, feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    assert np.isclose(trees.margin(one)[0], total)


def test_quality_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    for labels in (none, some):
        assert quality.score_quality(odd, labels).where("score BETWEEN 0 AND 1").count() == odd.count()
    assert quality.score_quality(nothing, none).count() == 0 and quality.keep_good(odd, none).columns == odd.columns


# Language model

def test_scores_are_sums_of_all_conditionals(spark, documents):
    model = pseudo_likelihood.WindowNetwork(np.random.default_rng(8).normal(0, 0.3, len(pseudo_likelihood.WindowNetwork().flat)).astype(np.float32))
    context = np.array([[1, 2, 3, pseudo_likelihood.VOCABULARY]])
    every = [model.log_probability(context, np.array([w]))[0] for w in range(pseudo_likelihood.VOCABULARY)]
    assert np.isclose(np.exp(every).sum(), 1, atol=1e-4)
    assert pseudo_likelihood.WindowNetwork.windows(np.array([5, 6])).tolist() == [[1024, 1024, 6, 1024], [1024, 5, 1024, 1024]]


def test_training_helps(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    before, after = (pseudo_likelihood.pseudo_likelihood(docs, rounds=n).agg({"score": "sum"}).first()[0] for n in (0, 2))
    assert after > 0.95 * before


def test_every_word_is_a_target_once(spark):
    for rounds in (1, 2, 3, 8):
        for n in range(20):
            assert sorted(i for k in range(rounds) for i in pseudo_likelihood.picked(n, k, rounds)) == list(range(n))
    short = spark.createDataFrame([(k, ("alpha", "alpha beta", "alpha beta gamma")[k % 3]) for k in range(300)], "doc_id long, text string")
    before, after = (pseudo_likelihood.pseudo_likelihood(short, **how).agg({"score": "sum"}).first()[0] for how in ({"rounds": 0}, {}))
    assert after > 0.9 * before


def test_rare_words_keep_their_identity(spark):
    known, none = np.sort(pseudo_likelihood.word_hashes("the and")), np.arange(2)
    spelled = {w: tuple(pseudo_likelihood.units(w, known, none)) for w in [f"w{k}" for k in range(5000)] + ["the", "and", "a b", "ab"]}
    assert len(set(spelled.values())) == len(spelled) and len(spelled["the"]) == len(spelled["and"]) == 1
    ids = pseudo_likelihood.units("the Ab and", known, none)
    a, b, end = pseudo_likelihood.FREQUENT + ord("a"), pseudo_likelihood.FREQUENT + ord("b"), pseudo_likelihood.END
    assert ids[1:4].tolist() == [a, b, end]
    assert pseudo_likelihood.WindowNetwork.windows(ids)[1:4].tolist() == [[1024, ids[0], ids[4], 1024], [ids[0], a, ids[4], 1024], [a, b, ids[4], 1024]]
    common = " ".join(f"c{k}" for k in range(pseudo_likelihood.FREQUENT))  # fills the table of frequent words
    made = [common] * 3 + ["station nation ration notation"] * 2 + [f"{w}ation" for w in ("s", "n", "r", "c", "f")] + ["zqxjk", "qzkxw"]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    found = as_dict(pseudo_likelihood.pseudo_likelihood(rows, batch=64))
    assert found[3]["n_tokens"] == 4 and found[0]["n_tokens"] == pseudo_likelihood.FREQUENT
    assert len({found[k]["score"] for k in range(5, len(made))}) == len(made) - 5


def test_scores_of_odd_rows(odd, nothing):
    found = [r for r in pseudo_likelihood.pseudo_likelihood(odd).collect()]
    empty = [r for r in found if r["doc_id"] in (1, 2)]
    assert len(found) == odd.count() and all(r["score"] == 0 and r["mean_score"] is None and r["n_tokens"] == 0 for r in empty)
    assert len({r["score"] for r in found if r["doc_id"] in (3, 4)}) == 1 and pseudo_likelihood.pseudo_likelihood(nothing).count() == 0



def test_a_training_step_follows_the_slope():
    """One step against slopes of the mean log-probability by differences; what has no slope stays, to the last bit."""
    random = np.random.default_rng(12)
    net = pseudo_likelihood.WindowNetwork(random.normal(0, 0.3, len(pseudo_likelihood.WindowNetwork().flat)).astype(np.float32))
    context, target = random.choice([0, 3, 770, 1000, 1024], (50, 4)), random.choice([1, 2, 33, 800, 1023], 50)
    order, kind, own = net._by_class(target)
    assert sorted(order) == list(range(50)) and kind.tolist() == sorted(target // 32) and [c for c, _, _ in own] == sorted(set(target // 32))
    start = net.flat.copy()
    net.train(context, target, 0.1)
    slope = np.sqrt(net.slope2 - np.float32(1e-3)) * np.sign(net.flat - start)
    touched = np.flatnonzero(net.flat != start)
    for at in random.choice(touched[np.abs(slope[touched]) > 0.01], 20):
        ends = []
        for by in (0.01, -0.01):
            moved = start.copy()
            moved[at] += by
            ends.append(pseudo_likelihood.WindowNetwork(moved).log_probability(context, target).mean())
        assert np.isclose((ends[0] - ends[1]) / 0.02, slope[at], rtol=0.02, atol=1e-3)
    unseen = net.embed[0][np.setdiff1d(np.arange(1025), context[:, 0])]
    assert np.array_equal(unseen, pseudo_likelihood.WindowNetwork(start).embed[0][np.setdiff1d(np.arange(1025), context[:, 0])])


def test_pieces_spell_words_in_few_units(documents):
    """Against the longest piece found byte by byte; a word had nearly five units when all but 768 words were spelled in single bytes."""
    texts = [r["text"] for r in documents.select("text").collect()] + [None, "", " \t\n", "b " + "ab" * 300 + "x", "\x00 a\x00", "É ñ\tx\x0by  "]
    counts = Counter(w for text in texts for w in pseudo_likelihood._words(text))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    common, rest = ranked[: pseudo_likelihood.FREQUENT], ranked[pseudo_likelihood.FREQUENT :]
    pieces = pseudo_likelihood.learned_pieces(rest, [counts[w] for w in rest], pseudo_likelihood.PIECES)
    assert len(set(pieces)) == len(pieces) == pseudo_likelihood.PIECES and all(2 <= len(p) <= pseudo_likelihood.LONGEST and b" " not in p[:-1] for p in pieces)
    number = {bytes([b]): pseudo_likelihood.FREQUENT + b for b in range(256)} | {p: pseudo_likelihood.VOCABULARY + k for k, p in enumerate(pieces)}

    def spelled(word):
        out = []
        while word:
            size = max(n for n in range(1, pseudo_likelihood.LONGEST + 1) if word[:n] in number)
            out.append(number[word[:size]])
            word = word[size:]
        return out

    whole = {w: k for k, w in enumerate(common)}
    spell, last = pseudo_likelihood.Units(whole, pieces), pseudo_likelihood.lasts(pieces)
    found = spell(texts)
    assert [f.tolist() for f in found] == [[u for w in pseudo_likelihood._words(t) for u in ([whole[w]] if w in whole else spelled(w + b" "))] for t in texts]
    assert [int(last[f].sum()) for f in found] == [len(pseudo_likelihood._words(t)) for t in texts]
    assert sum(map(len, found)) < 2.5 * sum(counts.values())
    alone = [pseudo_likelihood.windows_of([f], last) for f in found]
    assert np.array_equal(pseudo_likelihood.windows_of(found, last), np.concatenate(alone, 1))


def test_vocabulary_is_counted_over_all_documents(documents, nothing, monkeypatch):
    counts = Counter(w for r in documents.select("text").collect() for w in pseudo_likelihood._words(r["text"]))
    ranked = sorted(counts, key=lambda w: (-counts[w], w + b" "))
    for frequent, examples in ((pseudo_likelihood.FREQUENT, 200), (5, 3), (len(ranked), 10)):
        monkeypatch.setattr(pseudo_likelihood, "FREQUENT", frequent)
        monkeypatch.setattr(pseudo_likelihood, "EXAMPLES", examples)
        some = ranked[frequent : frequent + examples]
        assert pseudo_likelihood._vocabulary(documents) == (ranked[:frequent], pseudo_likelihood.learned_pieces(some, [counts[w] for w in some], pseudo_likelihood.PIECES))
    assert pseudo_likelihood._vocabulary(nothing) == ([], [])


def test_pieces_are_merged_by_count():
    assert pseudo_likelihood.learned_pieces([b"aaab", b"ab"], [5, 4], 3) == [b"aa", b"ab", b"ab "]
    assert pseudo_likelihood.learned_pieces([], [], 3) == [] and pseudo_likelihood.learned_pieces([b"x"], [1], 9) == [b"x "]


def test_network_on_more_units():
    """A network with units beside the bytes, the last class not full: probabilities add up to 1; sums of runs agree with adding one by one."""
    random, size = np.random.default_rng(5), pseudo_likelihood.VOCABULARY + 77
    net = pseudo_likelihood.WindowNetwork(None, size)
    net.train(random.integers(0, size + 1, (500, 4)), random.integers(0, size, 500), 0.1)
    every = net.log_probability(np.tile([1, size, 1030, 2], (size, 1)), np.arange(size))
    assert np.isclose(np.exp(every).sum(), 1, atol=1e-4)
    back, runs = random.normal(0, 1, (50, 32)).astype(np.float32), [1, 40, 3, 1, 12, 13, 2]
    row, first = random.integers(0, 50, sum(runs)), np.cumsum([0] + runs[:-1])
    got = {int(k): total for some, totals in net._sums(back, row, first) for k, total in zip(some, totals)}
    assert all(np.allclose(got[k], back[row[a : a + n]].sum(0), atol=1e-5) for k, (a, n) in enumerate(zip(first, runs)))


# Pages

PAGES = {
    None: "", "": "", "<p>": "", "hello &amp;  you": "hello & you",
    '<div id="cookie-notice">We use cookies</div><div class="content"><h1>T</h1><p>Para one is long enough.</p><div class="comments"><p>nice</p></div></div><aside>x</aside>': "T\nPara one is long enough.",
    '<article><header><h1>T</h1><span>menu</span></header><p>x<script>var a="</article>"</script> y<p>z</p></article><footer>f</footer>': "T\nx y\nz",
    '<nav><a href="/">Home</a></nav><main><ul><li>one</li><li>two</li></ul><form><label>q</label></form></main>': "one\ntwo",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page]


def article_text(page: str) -> str:
    import html

    article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(b for b in blocks if b)


def test_pages_without_names(spark):
    """Ratios, smoothing and clusters alone find the article where no element has a telling name."""
    pages = [r["html"] for r in spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/pages.parquet").collect()]
    bare = [re.sub(r' (class|id|role)="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer|header|aside|main)\b", r"<\1div", p)) for p in pages]
    assert sum(html_text.main_text(b) == article_text(p) for b, p in zip(bare, pages)) >= 0.97 * len(pages)


def test_clusters_choose_the_lines(monkeypatch):
    story = "".join(f"<p>{'word ' * (20 + 7 * k)}</p>" for k in range(6))
    links = "<ul>" + "".join(f'<li><a href="/{k}">somewhere else {k}</a></li>' for k in range(9)) + "</ul>"
    page = f"<div>{links}</div><div><h2>Title</h2>{story}<p>End.</p></div><div>Short note.</div><div>{links}</div>"
    text = "\n".join(["Title", *[("word " * (20 + 7 * k)).strip() for k in range(6)], "End."])
    assert html_text.main_text(page) == text
    shuffled = f"<div>{story}</div><div>{links}</div>"
    assert "somewhere" not in html_text.main_text(shuffled)
    assert html_text.main_text(f'<div id="main"><div class="post"><h1>T</h1><div class="content">{story}</div></div><div class="more">{story}</div></div>').startswith("T\n")
    noted = f'<article><h1>T</h1>{story}<div class="ad">Buy this now</div></article>'
    assert "Buy" not in html_text.main_text(noted) and html_text.main_text(noted).startswith("T\n")
    monkeypatch.setattr(html_text, "high_cluster", lambda v: np.zeros(len(v), dtype=bool))
    assert html_text.main_text(page) == html_text.main_text(noted) == ""
    monkeypatch.setattr(html_text, "high_cluster", lambda v: np.ones(len(v), dtype=bool))
    assert "Buy" in html_text.main_text(noted)


def test_smoothing_against_a_plain_sum():
    line = lambda n, home: html_text.Line("x" * n, 1, 0, False, True, False, home)
    lines = [line(n, h) for n, h in ((5, 1), (90, 1), (3, 2), (40, 2), (7, 2), (200, 3), (1, 1))]
    for i, found in enumerate(html_text.smoothed_ratios(lines)):
        near = [np.exp(-0.5 * (i - j) ** 2) * (1 if x.home == lines[i].home else html_text.ELSEWHERE) * (abs(i - j) <= 3) for j, x in enumerate(lines)]
        assert np.isclose(found, sum(w * np.log1p(len(x.text)) for w, x in zip(near, lines)) / sum(near))


def test_long_deep_and_repeated_pages(spark):
    import time

    took = []
    for n in (5_000, 50_000):
        began = time.perf_counter()
        assert html_text.main_text("<div>" * n + "</ul>" * n + "a text without an end") == "a text without an end"
        assert len(html_text.main_text("<div>some words of it" * n)) == 17 * n - 1
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]  # ten times the tags; the square would be a hundred
    long = f"<nav><a href=x>no</a></nav><article><h1>T</h1><p>{'very long text ' * 200_000}</p></article>"
    rows = [(1, "u", long, "mine"), (2, None, "<p>same text here</p>", "a"), (2, None, "<p>same text here</p>", "a"), (None, "v", None, None)]
    found = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found) == [(0, 0), (1, 2 + 15 * 200_000 - 1), (2, 14), (2, 14)]


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = as_dict(html_text.extract_main_text(pages), "page_id")
    for r in pages.collect():
        text = article_text(r["html"])
        assert found[r["page_id"]]["text"] == text and found[r["page_id"]]["n_chars"] == len(text)
    assert html_text.extract_main_text(pages.where("false")).count() == 0


@pytest.mark.parametrize("lead", [0.05, 1.0])
def test_leading_share_changes_no_result(documents, lead):
    at = lambda df: sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())
    assert at(jaccard.similar_classes(documents, width=5, percent=80, lead=lead)) == at(jaccard.similar_classes(documents, width=5, percent=80))


def test_places_of_shared_grams_are_shuffled_once(spark, monkeypatch):
    plans, stored = {}, repeats.store
    monkeypatch.setattr(repeats, "store", lambda df, label="state": plans.__setitem__(label, df._jdf.queryExecution().executedPlan().toString()) or stored(df, label))
    text = "".join(chr(97 + i * i % 23) for i in range(260))
    docs = spark.createDataFrame([(1, "x" + text), (2, text + "y"), (3, text + "y"), (4, "short"), (None, text[:230])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: 260, 2: 261, 3: 261, 4: 0, None: 230}
    assert "Exchange hashpartitioning" not in plans["places"] and plans["segments"].count("Exchange hashpartitioning") <= 3
