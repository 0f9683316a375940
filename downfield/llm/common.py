"""Column and table helpers that several corpus operators share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered and nothing else. ``lower`` would also change other letters, so it serves texts without any."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Small sides of joins are sent to every executor up to this number of rows, else joined by shuffle.
BROADCAST_ROWS = 1_000_000
KEYS = ["__k1", "__k2"]


def unused(name: str, *frames: DataFrame) -> str:
    """``name`` with so many underscores before it that no column of ``frames`` has it, in whatever case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_key(names: list[str] = KEYS) -> list[Column]:
    """128 bits that name a row by its doc_id and text; never null. Repeated rows share them."""
    return [F.xxhash64("doc_id", "text").alias(names[0]), F.xxhash64(F.lit(1), "doc_id", "text").alias(names[1])]


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``rejected`` (a written table of KEYS), all columns unchanged. Few keys
    are broadcast, so that the texts are not shuffled."""
    own = [unused(k, docs) for k in KEYS]
    keyed = docs.withColumns(dict(zip(own, row_key(own))))
    gone = small(rejected.select(*[F.col(k).alias(o) for k, o in zip(KEYS, own)]))
    return keyed.join(gone, own, "left_anti").drop(*own)
