"""Ranked search, the Merkle manifest and token files against brute-force versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import HARD, ITEMS, SCHEMA, contract_words, rows
from tokenizers import Tokenizer

from downfield.llm import merkle, queries, search, tokens
from downfield.llm.common import table

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", params=["hard", "docs", "empty"])
def any_docs(request, spark, sf):
    if request.param == "docs":
        return table(spark, sf, "documents")
    return spark.createDataFrame(HARD if request.param == "hard" else [], SCHEMA)


def null_first(value):
    return (value is not None, value or 0)


# search ----------------------------------------------------------------------------------------------------------------

def best_documents(docs, items, k):
    held = [(i, Counter(contract_words(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = Counter()
    for item_id, text in items:
        found = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // max(length, 1)
            score = sum(weight[t] * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(contract_words(text)) if c[t])
            if score > 0:
                found.append((-score, null_first(i), i))
        for place, (score, _, i) in enumerate(sorted(found)[:k], 1):
            out[item_id, place, i, -score] += 1
    return out


@pytest.mark.parametrize("k,block", [(50, 1 << 15), (3, 40), (1, 7)])
def test_search(spark, sf, any_docs, monkeypatch, k, block):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    own = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, rank int, score int")
    docs = [(r["doc_id"], r["text"]) for r in any_docs.collect()]
    for benchmark in (own, table(spark, sf, "benchmark"), own.limit(0)):
        items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
        got = search.rank(any_docs, benchmark, k)
        assert rows(got, "item_id", "rank", "doc_id", "score") == best_documents(docs, items, k)


def test_search_beyond_what_is_sent_to_tasks(spark, sf, monkeypatch):
    docs, benchmark = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = rows(search.rank(docs, benchmark), "item_id", "rank", "doc_id", "score")
    monkeypatch.setattr(search, "SENT_TERMS", 10)
    monkeypatch.setattr(search, "PASS_ITEMS", 7)
    assert rows(search.rank(docs, benchmark), "item_id", "rank", "doc_id", "score") == want


def test_intervals_resolve_ties_and_rare_terms():
    rng = np.random.default_rng(2)
    for trial in range(60):
        n_docs, n_terms = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        held = rng.random((n_docs, n_terms)) < rng.random(n_terms)
        impact = np.where(held, rng.integers(1, [4, 1000, 10 ** 9][trial % 3], (n_docs, n_terms)), 0)
        doc, term = np.nonzero(impact)
        lists = search.Lists(doc, term, impact[doc, term], n_docs, n_terms)
        asked = np.flatnonzero(rng.random(n_terms) < .7)
        total, k = impact[:, asked].sum(axis=1), int(rng.integers(1, 20))
        docs, scores = lists.best(asked, k)
        assert (total[docs] == scores).all() and len(set(docs.tolist())) == len(docs)
        least = np.sort(total)[-k] if n_docs >= k else 0
        assert set(np.flatnonzero(total >= max(least, 1)).tolist()) <= set(docs.tolist())


def test_intervals_leave_most_documents_unread():
    """Only documents that may still belong are read on for."""
    n = 5000
    rare, common = np.full(60, 10 ** 9), np.arange(n, 0, -1)
    doc, term = np.concatenate([np.arange(60) * 7, np.arange(n)]), np.repeat([0, 1], [60, n])
    docs, _ = search.Lists(doc, term, np.concatenate([rare, common]), n, 2).best(np.array([0, 1]), 50)
    assert set(docs.tolist()) <= set((np.arange(60) * 7).tolist())


# Merkle ----------------------------------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbed(nodes):
    """(root, for each leaf its list of (before, after)) of the digests ``nodes``."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, places = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i:i + 2]
            for j in range(len(run)):
                for own in at[i + j]:
                    paths[own].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(sha("".join(run)))
            places.append([x for j in range(len(run)) for x in at[i + j]])
        nodes, at = above, places
    return nodes[0], paths


def proofs(data):
    own = [(r, sha("".join(field(r[f]) for f in merkle.FIELDS))) for r in data]
    groups = {}
    for r, h in sorted(own, key=lambda x: (null_first(x[0]["doc_id"]), x[1])):
        groups.setdefault(r["lang"], []).append((r, h))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: climbed([h for _, h in groups[g]]) for g in order}
    root, upper = climbed([inner[g][0] for g in order]) if order else (None, [])
    for g, top in zip(order, upper):
        for (r, h), path in zip(groups[g], inner[g][1]):
            yield r, h, inner[g][0], root, path + top


def manifest_rows(data):
    out = Counter()
    for r, h, subroot, root, path in proofs(data):
        node = h
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
            node = sha("".join(field(r[f] + (f == "n_chars") if f == "n_chars" else r[f]) for f in merkle.FIELDS))
        for before, after in path:
            node = sha(before + node + after)
        out[r["doc_id"], h, subroot, root, sha("".join(a + b for a, b in path)), node, node == root] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("bits", [10, 2])
def test_merkle(any_docs, monkeypatch, bits):
    """Small blocks make several storeys."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    monkeypatch.setattr(queries, "table", lambda *_: any_docs)
    data = [r.asDict() for r in any_docs.collect()]
    want = manifest_rows(data)
    assert rows(queries.op12(None, None), *COLUMNS) == want
    assert {k[-1] for k in want} == ({False, True} if len(data) > 100 else {True, False} & {k[-1] for k in want})


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 65])
def test_merkle_of_every_size(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("x").alias("lang"),
                                 F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    told = merkle.manifest(docs)
    want = Counter((r["doc_id"], h, subroot, root, tuple(path)) for r, h, subroot, root, path in proofs([r.asDict() for r in docs.collect()]))
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in told.collect())
    assert got == want
    assert told.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).where("not ok").isEmpty()


# token ids -------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_ids_of_whole_texts(plain, monkeypatch):
    monkeypatch.setattr(tokens, "PART_CHARS", 7)
    monkeypatch.setattr(tokens, "KNOWN", 500)
    with open(BPE, encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    rng = random.Random(1)
    signs = "aAbIl sdtmrve''  \n\t \r\x0b\x00\x1c\x1f\x85é×÷ßñ1²Ⅳ٣!?.,_-<|>…“中文　  \U0001f511é"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) + "<|endoftext|>" * (i % 9 == 0) for i in range(3000)]
    texts += ["x" * 5000, "÷" * 3000 + " a", "a÷" * 2000, " " * 3000]
    got = [[] for _ in texts]
    for number, ids, _ in encoder.stream(texts):
        got[number] += ids.tolist()
    for text, ids in zip(texts, got):
        assert ids == plain(text), repr(text[:80])


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_special_tokens_as_the_library_has_them(monkeypatch, part):
    monkeypatch.setattr(tokens, "PART_CHARS", part)
    library = Tokenizer.from_file(BPE)
    with open(BPE, encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read(), special=True)
    rng = random.Random(2)
    signs = ["<|endoftext|>", "<|", "|>", "endoftext", "a", "I", "'s", " ", "  ", "\n", "é", "中", "1", "!", "\x00"]
    texts = ["", "<|endoftext|>", "<|endoftext|>" * 3, "x <|endoftext|> y", "<|endoftext|" * 2 + ">"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1000)]
    got, ended = [[] for _ in texts], []
    for number, ids, last in encoder.stream(texts):
        got[number] += ids.tolist()
        ended += [number] * last
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ended == list(range(len(texts)))


def test_query_encodes_special_tokens(spark, tmp_path):
    texts = {1: "a <|endoftext|>b", 2: None, 3: "<|endoftext|>"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library, at = Tokenizer.from_file(BPE), 0
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_tokens"](spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (1, 0), (7, 50_000), (4097, 2), (1000, np.iinfo(kind).max)):
        values = rng.integers(0, top, n, dtype=kind, endpoint=True)
        assert tokens.values_of(tokens.planes(values), n, values.itemsize).tolist() == values.tolist()


def test_tokens(spark, any_docs, plain, monkeypatch):
    for chunk, file in ((1 << 16, 1 << 23), (64, 500)):
        monkeypatch.setattr(tokens, "CHUNK_IDS", chunk)
        monkeypatch.setattr(tokens, "FILE_IDS", file)
        got = [tuple(r) for r in tokens.round_trip(spark, any_docs, BPE).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
        want = Counter()
        for r in any_docs.collect():
            ids = plain(r["text"]) + [0]
            want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert Counter((i, n, crc) for i, _, n, crc in got) == want
        at = 0
        for i, start, n, _ in sorted(got, key=lambda r: r[1]):
            assert start == at
            at += n
        order = [null_first(i) for i, *_ in sorted(got, key=lambda r: r[1])]
        assert order == sorted(order)


def test_ids_are_found_by_their_place(spark, sf, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_IDS", 100)
    docs = table(spark, sf, "documents")
    files = tokens.write(docs, str(tmp_path), BPE).orderBy("part", "seq").collect()
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    flat = [x for t in texts for x in plain(t) + [0]]
    with pa.OSFile(str(tmp_path / files[0]["file"])) as f:
        reader = tokens.Reader(f, files[0]["bytes"])
        for start, n in ((0, 1), (99, 2), (150, 777), (files[0]["n_ids"] - 5, 5), (3, 0)):
            assert reader.ids(start, n).tolist() == flat[start:start + n]
    assert sum(f["n_ids"] for f in files) == len(flat) and sum(f["bytes"] for f in files) < 4 * len(flat)
