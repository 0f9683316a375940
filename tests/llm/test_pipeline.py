"""The corpus pipeline against a brute-force version, and its stages on hard rows."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from test_operators import HARD, SCHEMA, component_ids, contamination_of, jump, near_targets, print_of, targets, tokens

from downfield.llm import mixing, toxicity
from downfield.llm.common import table
from downfield.session import materialise


def is_toxic(model, text):
    z = model.bias + sum(model.weights.get(i, 0.0) for t in toxicity.terms(text) for i in toxicity.features(t))
    return 1 / (1 + np.exp(-z)) >= toxicity.THRESHOLD


def one_of_each(rows):
    best = {}
    for r, c in zip(rows, component_ids([(r["doc_id"], print_of(r["text"])) for r in rows], 2)):
        if c not in best or r["doc_id"] < best[c]["doc_id"]:
            best[c] = r
    return list(best.values())


def test_run_equals_brute_force(spark, sf):
    docs = [r.asDict() for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = [r for r in docs if not is_toxic(model, r["text"])]
    rows = one_of_each(rows)
    rows = [r for r in rows if not contamination_of(r["text"], items)[-1]]
    text = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    got = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    times = Counter(r["doc_id"] for r in got)
    assert set(times) <= set(text)
    for r in got:
        own = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["shard"]) == (len(own) + 1, zlib.crc32(own), jump(xxhash.xxh64_intdigest(str(r["doc_id"]).encode(), 42), 8))
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(tokens(r["text"]))
    target = targets(sizes)
    near_targets([(r["source"], len(tokens(r["text"])), times[r["doc_id"]], target[r["source"]]) for r in rows])
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_follow_the_training_order(spark, sf):
    docs = table(spark, sf, "documents")
    mixed = materialise(corpus_pipeline.mix_sources(spark, docs, sf))
    files = mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    order = [r["doc_id"] for r in sorted(files, key=lambda r: (r["file_name"], r["row_index"]))]
    placed = corpus_pipeline.place(spark, mixed, sf).collect()
    shard = {r["doc_id"]: r["shard"] for r in placed}
    for s in range(corpus_pipeline.SHARDS):
        own = [r["doc_id"] for r in sorted((r for r in placed if r["shard"] == s), key=lambda r: r["slot"])]
        assert own == [d for d in order if shard[d] == s]
    first = {r["doc_id"]: r["positions"] for r in mixing.plan(docs).collect()}
    at = [first[d][order[:i].count(d)] for i, d in enumerate(order)]
    assert at == sorted(at)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_hard_rows(spark, sf, name, stage, empty):
    docs = spark.createDataFrame([] if empty else HARD, SCHEMA)
    out = stage(spark, docs, sf)
    if name != "sharding":
        assert out.columns == docs.columns
        given = Counter(docs.collect())
        assert all(n <= 3 * given[r] for r, n in Counter(out.collect()).items())  # rows unchanged, at most thrice
    ids = {r["doc_id"] for r in out.collect()}
    assert ids <= {r["doc_id"] for r in docs.collect()}
    assert empty or ids
