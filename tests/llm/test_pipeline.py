"""The corpus pipeline stage by stage, and the registration of all queries."""

from collections import Counter
from itertools import groupby

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from solea.llm.jaccard import similar_classes
from solea.llm.mixing import target_weights
from solea.llm.quality import score_quality
from tests.llm.conftest import DATA
from tests.llm.test_texts import brute_components, brute_spans, largest_deviation


def test_all_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, DATA)
    accepted = {r["doc_id"] for r in score_quality(docs, labels).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == accepted
    one = stages["n-gram Jaccard join"](spark, good, DATA)
    groups = brute_components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted({root for _, root in groups.values()})
    hidden = stages["PII"](spark, one, DATA)
    assert hidden.columns == docs.columns and hidden.count() == one.count()
    assert not any(brute_spans(r["text"]) for r in hidden.collect())
    mixed = stages["mixing sources"](spark, hidden, DATA)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, hidden.collect()))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages["BPE encoding and decoding"](spark, mixed.limit(40), DATA).join(mixed.select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_text"] == library.decode(ids, skip_special_tokens=False)


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) and all(r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_rows_of_run_are_mixed(spark):
    """Over several files, whose order is not kept when they are read."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = corpus_pipeline.run(spark, DATA.replace("0.001", "0.01"))
        assert len(result.inputFiles()) > 1
        rows = result.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    places = [r["position"] for r in rows]
    assert places == sorted(set(places)) and all(r["slot"] == r["position"] // 64 for r in rows)
    sizes = Counter(r["source"] for r in rows)
    order = [source for (source, _), _ in groupby(rows, key=lambda r: (r["source"], r["slot"]))]
    blocks = {s: -(-n // 64) for s, n in sizes.items()}
    assert Counter(order) == blocks and largest_deviation(order, blocks, target_weights(sizes, None, 0.7, 200)) < 1


def test_odd_rows_go_through_every_stage(spark, odd, nothing):
    for rows in (odd, nothing):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, DATA)
        assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in rows.collect()} - {4}
    assert similar_classes(odd).where("doc_id = 4 AND component_id = 3").count() == 2
