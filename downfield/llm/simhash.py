"""SimHash near-duplicates by covering locality-sensitive hashing."""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import KEYS, row_key, unused, without
from downfield.llm.graph import components
from downfield.session import materialise

BITS = 64
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit is 1 if set in more than half of the shingle hashes (XXH64, seed 42); repeated shingles count again. Words
    are runs other than ASCII white space, A-Z lowered. A text of fewer words is one shingle, one of none gives 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < shingle:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(shingle)))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return simhash(text)


def masks(radius: int) -> list[int]:
    """Masks of which at least one keeps no differing bit, for any ``radius`` differing bits.

    Bit i carries a vector m(i) of radius + 1 binary digits, not zero; the mask of vector v keeps the bits with an odd
    product of m(i) and v. Any ``radius`` vectors leave a v orthogonal to all of them, whose mask drops those bits."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % size) & v).bit_count() % 2) for v in range(1, size + 1)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) over the distinct column ``fp`` of ``prints``: what links of ``radius`` or fewer differing bits
    connect, the edges connect, and every edge is such a link.

    Buckets are equal masked prints. In a bucket of two the pair is compared. In a larger one every print is filed
    under all prints that differ from it outside the mask in half the radius, rounded down and rounded up; two prints of
    the bucket are within the radius exactly if they meet at one of these middles, one from each side. A bucket of any
    size thus costs its length times a constant, and no pairs are made. Few prints can meet at a middle, as they are
    distinct and within half the radius of it."""
    if not 1 <= radius <= 3:
        raise ValueError("the radius must be 1, 2 or 3")
    covering = masks(radius)
    filed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
        for t, m in enumerate(covering)])).alias("f")).select("fp", "f.t", "f.key")
    sizes = materialise(filed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"),
                                                     F.max("fp").alias("b")).where("n > 1"))
    pairs = sizes.where(F.col("n") == 2).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    crowd = filed.join(sizes.where("n > 2").select("t", "key"), ["t", "key"])

    def met(apart: int, near: bool) -> DataFrame:
        flips = F.array(*[F.array(*[F.lit(x) for x in _flips(m, apart)]) for m in covering])
        return (crowd.select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
                .select(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), "fp", F.lit(near).alias("near")))

    low, high = radius // 2, radius - radius // 2
    sides = met(low, True) if low == high else met(low, True).union(met(high, False))
    stars = (sides.groupBy("middle").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"),
                                         F.collect_set("fp").alias("all"))
             .where(F.col("a").isNotNull() & (F.size("all") > 1)).select("a", F.explode("all").alias("b")).where("a <> b"))
    return pairs.select("a", "b").union(stars).distinct()


def _flips(mask: int, apart: int) -> list[int]:
    """All ways to change up to ``apart`` bits outside ``mask``."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [signed(sum(1 << i for i in chosen)) for n in range(apart + 1) for chosen in combinations(free, n)]


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64-bit print), root (the print that names the component),
    component_id, the smallest doc_id reachable over links of ``radius`` or fewer differing bits, and the row's key.

    Texts without words share print 0 and link like any other; repeated rows stay, null ids count in no minimum,
    other columns are ignored."""
    prints = materialise(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp"), *row_key()))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, radius))
    named = materialise(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(least, "root"), "fp").select(
        "doc_id", "fp", "root", "component_id", *KEYS)


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id (null last; then by key), once, in all its
    columns. Rows equal in doc_id and text count as one row."""
    marked = materialise(near_duplicates(docs, shingle, radius))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEYS)).alias("first")
    chosen = marked.groupBy("root").agg(first).select(*[F.col(f"first.{k}").alias(k) for k in KEYS])
    losers = materialise(marked.select(*KEYS).join(chosen, KEYS, "left_anti").distinct())
    kept = without(docs, losers)
    repeated = marked.groupBy(*KEYS).count().where("count > 1")
    if repeated.isEmpty():
        return kept
    own = [unused(k, docs) for k in KEYS]
    return kept.withColumns(dict(zip(own, row_key(own)))).dropDuplicates(own).drop(*own)
