"""A Merkle manifest of a table: one digest tree per group of rows, one over the groups, and a proof for every row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.operators.numbering import running
from downfield.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A block has two to this power of leaves; its tree is nested in one row, about 150 bytes a leaf.
BLOCK_BITS = 10
# Proofs of up to so many groups are sent to every executor (at most some 14 digests each), more are joined by shuffle.
BROADCAST_GROUPS = 10_000
PROOF = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field is ``-`` if null, else its number of UTF-8 bytes, a colon and its text."""
    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(told, fields)))


def _width(k: int) -> Column:
    """Nodes that a group of ``n`` leaves has after ``k`` halvings."""
    return F.shiftright(F.col("n") + ((1 << k) - 1), k)


def rollup(leaves: DataFrame, bits: int) -> DataFrame:
    """(g, n, block, node): the trees of all blocks of 2 ** ``bits`` of (g, n, rank, hash, item), n leaves of group g numbered
    from 0.

    The binary digits of a rank within its block are columns, and are grouped away one after the other, from the lowest:
    each grouping nests the nodes that differ in that digit only into their parent. Rows are dealt and sorted once, by group, block and
    digits; every grouping streams over that order, so there is no further exchange or sort. A group that is down to one
    node passes it on unhashed."""
    digits = [f"d{k}" for k in range(bits)]
    keys = ["g", "n", "block"]
    nodes = leaves.select("g", "n", F.shiftright("rank", bits).alias("block"),
                          *[F.shiftright("rank", k).bitwiseAND(F.lit(1)).alias(d) for k, d in enumerate(digits)],
                          F.struct("hash", "item").alias("node"))
    nodes = nodes.repartition(*keys).sortWithinPartitions(*keys, *reversed(digits))
    for k, digit in enumerate(digits):
        left = [*keys, *reversed(digits[k + 1:])]
        run = F.array_compact(F.array(*[F.max(F.when(F.col(digit) == side, F.col("node"))) for side in (0, 1)]))
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        own = F.when(_width(k) > 1, digest(joined)).otherwise(F.get("kids", F.lit(0))["hash"])
        nodes = nodes.groupBy(*left).agg(run.alias("kids")).select(*left, F.struct(own.alias("hash"), "kids").alias("node"))
    return nodes


def unfold(blocks: DataFrame, bits: int) -> DataFrame:
    """(g, hash, item, proof) of every leaf of (g, n, node, proof): the nested nodes are exploded from the top, and each
    puts the rest of its run before the proof of its parent."""
    rows = blocks
    for k in reversed(range(bits)):
        run = F.transform("node.kids", lambda x: x["hash"])
        rows = rows.select("g", "n", "proof", run.alias("run"), F.posexplode("node.kids").alias("at", "node"))
        others = F.struct(F.array_join(F.slice("run", F.lit(1), F.col("at")), "").alias("before"),
                          F.array_join(F.slice("run", F.col("at") + 2, F.size("run")), "").alias("after"))
        rows = rows.select("g", "n", F.when(_width(k) > 1, F.concat(F.array(others), "proof")).otherwise(F.col("proof")).alias("proof"),
                           "node")
    return rows.select("g", "node.hash", "node.item", "proof")


def trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, root) of each group, and (g, hash, item, proof) of each leaf of (g, n, rank, hash, item). Blocks are rolled up, then
    their roots as leaves of larger ones, until each group has one; proofs go the other way, a join of blocks, not of
    leaves, for each storey."""
    nodes, storeys, most = leaves, [], leaves.agg(F.max("n")).first()[0] or 0
    while not storeys or most > 1:
        bits = min(BLOCK_BITS, max(1, (most - 1).bit_length()))
        storeys.append((materialise(rollup(nodes, bits)), bits))
        most = -(-most >> bits) if most > 1 else most
        nodes = storeys[-1][0].select("g", _width(bits).alias("n"), F.col("block").alias("rank"), "node.hash", F.struct("block").alias("item"))
    top, bits = storeys.pop()
    proven = unfold(top.withColumn("proof", F.array().cast(PROOF)), bits)
    for blocks, bits in reversed(storeys):
        above = proven.select("g", F.col("item.block").alias("block"), "proof")
        proven = unfold(blocks.join(above, ["g", "block"]), bits)
    return top.select("g", F.col("node.hash").alias("root")), proven


def numbered_leaves(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add the rank of each row in its group ``g`` and the group's number of rows ``n``."""
    placed = running(rows.withColumn("one", F.lit(1)), ["g"], order, "one").drop("one", "before")
    sizes = materialise(rows.groupBy("g").agg(F.count("*").alias("n")))
    return placed.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes, "g")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", **carried: Column) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``group``, leaf, subroot, root, proof (the digests beside the row's own in each run, from
    the leaf to the root, as those before and those after it) and the ``carried`` columns, computed from ``docs``.

    In each group rows ascend by key (null first, ties by leaf); every two consecutive nodes, or a last one alone, become
    one, until one remains. The groups' nodes, by group (null first, then by UTF-8 bytes), become the root in the same way. Null
    fields are marked as such; empty and very long texts are digested whole; repeated rows are leaves each; an empty table gives no
    row; other columns are ignored."""
    thin = materialise(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        leaf([F.col(f) for f in fields]).alias("hash"),
        F.struct(F.col(key).alias("key"), F.col(group).alias("group"), *[c.alias(n) for n, c in carried.items()]).alias("item")))
    subroots, rows = trees(numbered_leaves(thin, [F.col("item.key").asc_nulls_first(), F.col("hash")]))
    groups = subroots.select(F.lit("").alias("g"), F.col("root").alias("hash"), F.struct(F.col("g").alias("of")).alias("item"))
    root, tops = trees(numbered_leaves(materialise(groups), [F.col("item.of")]))
    tops = materialise(tops.join(root, "g").select(
        F.col("item.of").alias("g"), F.col("hash").alias("subroot"), "root", F.col("proof").alias("upper")))
    rows = rows.join(F.broadcast(tops) if tops.count() <= BROADCAST_GROUPS else tops, "g")
    return rows.select(F.col("item.key").alias(key), F.col("item.group").alias(group), F.col("hash").alias("leaf"), "subroot", "root",
                       F.concat("proof", "upper").alias("proof"), *[F.col(f"item.{n}").alias(n) for n in carried])


def folded(own: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, own, lambda node, x: digest(F.concat(x["before"], node, x["after"])))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""))
