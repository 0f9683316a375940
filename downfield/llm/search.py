"""Ranked lexical search by sequential reads of impact-sorted lists that keep score intervals (NRA)."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from downfield.llm.decontaminate import words
from downfield.session import materialise

TOP = 50
# Documents whose lists a task holds at a time, items that are answered in one pass over the lists, and the most distinct
# query terms that are sent to tasks to leave out all others.
BLOCK_DOCS, PASS_ITEMS, SENT_TERMS = 1 << 15, 10_000, 500_000
# Every character that ends a term becomes a space, A-Z become a-z, the rest stays.
_FOLD = bytes(c + 32 if chr(c).isascii() and chr(c).isupper() else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
COUNTED = "doc_id long, n long, terms array<string>, tfs array<long>"


def counted(docs: DataFrame, wanted: list[str] | None) -> DataFrame:
    """(doc_id, n, terms, tfs) per row of ``docs``: its number of terms with repeats, and how often each of its ``wanted``
    terms (None: every one) occurs in the whole text."""
    known = None if wanted is None else frozenset(t.encode() for t in wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                found = (text.as_py() or b"").translate(_FOLD).split()
                held = Counter(found)
                own = held.keys() if known is None else held.keys() & known
                sizes.append(len(found))
                terms += own
                tfs += [held[t] for t in own]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())),
                pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, COUNTED)


class Lists:
    """The impact-sorted lists of one block of documents: for each term the documents that hold it, highest impact first."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        top = int(impact.max()).bit_length() if len(impact) else 0
        # How far each list is read when all lists are read down to a power of two; the last reads are to the end.
        self.upto = [self.starts[:-1]] + [
            self.starts[:-1] + np.bincount(term[impact >= 1 << b], minlength=n_terms) for b in range(top - 1, -1, -1)]

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that contain the ``k`` highest scores over ``terms`` with all ties, exact.

        All lists are read in turns down to one impact after the other. What a document has got so far is its lower bound;
        with the next impact of each list that has not shown it, its upper bound. Once a document not yet seen cannot reach
        the k-th highest lower bound, membership is down to those whose upper bound reaches it. Only these are read on for, to
        the ends of the lists, where both bounds meet."""
        low = np.zeros(self.n_docs, np.int64)
        ends = self.starts[terms + 1]
        for before, upto in zip(self.upto, self.upto[1:]):
            for t in terms:
                new = slice(before[t], upto[t])
                low[self.doc[new]] += self.impact[new]
            following = np.where(upto[terms] < ends, self.impact[np.minimum(upto[terms], len(self.impact) - 1)], 0)
            unseen = int(following.sum())
            least = int(np.partition(low, -k)[-k]) if self.n_docs >= k else 0
            if unseen < least or not unseen:
                break
        else:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        high = low + unseen
        for t, f in zip(terms, following):
            if f:
                high[self.doc[self.starts[t]:upto[t]]] -= f
        member = (high >= max(least, 1))
        for t, end in zip(terms, ends):
            rest = slice(upto[t], end)
            docs = self.doc[rest]
            mine = member[docs]
            low[docs[mine]] += self.impact[rest][mine]
        docs = np.flatnonzero(member & (low > 0))
        return docs, low[docs]


def _ranked_blocks(listed: DataFrame, items: list[tuple[int, list[str]]], weights: dict[str, int], n: int, length: int, k: int) -> DataFrame:
    """(q, doc_id, score): the ``k`` best of every block of documents for every item."""
    names = sorted(weights)
    number = {t: i for i, t in enumerate(names)}
    weight = np.array([weights[t] for t in names], np.int64)
    queries = [(q, np.array(sorted(number[t] for t in terms if t in number), np.int64)) for q, terms in items]

    def answers(batch: pa.RecordBatch) -> pa.RecordBatch:
        term = pc.index_in(batch["terms"].combine_chunks().flatten(), value_set=pa.array(names, pa.string()))
        sizes = pc.list_value_length(batch["terms"]).to_numpy()
        known = pc.is_valid(term).to_numpy(zero_copy_only=False)
        term = pc.fill_null(term, 0).to_numpy()[known].astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)[known]
        tf = batch["tfs"].combine_chunks().flatten().to_numpy()[known]
        m = 50 + (50 * batch["n"].to_numpy() * n) // length
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        lists = Lists(doc[impact > 0], term[impact > 0], impact[impact > 0], len(sizes), len(names))
        doc_ids = batch["doc_id"].combine_chunks()
        null = pc.is_null(doc_ids).to_numpy(zero_copy_only=False)
        order_id = pc.fill_null(doc_ids, 0).to_numpy()
        out = [], [], []
        for q, terms in queries:
            docs, scores = lists.best(terms, k)
            first = np.lexsort((order_id[docs], ~null[docs], -scores))[:k]
            for column, values in zip(out, (np.full(len(first), q), docs[first], scores[first])):
                column.append(values)
        q, docs, scores = (np.concatenate([np.empty(0, np.int64), *c]) for c in out)
        return pa.RecordBatch.from_arrays([pa.array(q), doc_ids.take(pa.array(docs)), pa.array(scores)], ["q", "doc_id", "score"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_DOCS:
                yield answers(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield answers(pa.Table.from_batches(held))

    return listed.mapInArrow(blocks, "q long, doc_id long, score long")


def rank(docs: DataFrame, benchmark: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` documents of highest score for each row of ``benchmark``: item_id, rank (from 1), doc_id, score; equal scores by
    ascending doc_id (null first). Only scores above 0 count.

    Terms are runs of letters, digits and non-ASCII characters of whole texts, A-Z lower-cased. A term's weight falls with the
    number of documents that hold it, an impact rises with its occurrences and falls with the length of the document. A
    document lies in one block, so a block's lists resolve its own best documents, and the best of all blocks are the best of all.

    Null, empty and blank texts hold no term and are never found; items without a term have no row; repeated documents are
    found each, repeated items answered each; very long texts count whole; an empty table on either side gives no
    row; other columns are ignored."""
    items = materialise(benchmark.select("item_id", F.monotonically_increasing_id().alias("q"), F.array_distinct(words(F.col("text"))).alias("terms")))
    query_terms = items.select(F.explode("terms").alias("term")).distinct()
    few = query_terms.count() <= SENT_TERMS
    listed = materialise(counted(docs, [r["term"] for r in query_terms.collect()] if few else None))
    n, length = listed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = listed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1).cast("double")))
    if not few:
        held = held.join(query_terms, "term", "left_semi")
    weights = materialise(held.select("term", weight.alias("w")).where("w > 0"))
    passes, found = max(1, -(-items.count() // PASS_ITEMS)), None
    for p in range(passes):
        asked = items.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p)
        terms = asked.select(F.explode("terms").alias("term")).distinct()
        own = {r["term"]: r["w"] for r in weights.join(terms, "term", "left_semi").collect()}
        queries = [(r["q"], r["terms"]) for r in asked.select("q", "terms").collect()]  # some PASS_ITEMS
        best = _ranked_blocks(listed, queries, own, n, max(length, 1), k)
        found = best if found is None else found.union(best)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    top = found.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
