"""WARC archives with a two-level capture index."""

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.llm.common import small
from downfield.operators.numbering import running
from downfield.session import materialise, new_dir

# A task starts a new archive beyond so many compressed bytes, and an index block beyond so many entries; one task reads
# back the captures of so many blocks.
ARCHIVE_BYTES, BLOCK_ENTRIES, BLOCKS_PER_TASK = 256 << 20, 1000, 4
# Records that lie closer than this are read in one piece, up to the second figure.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
RECORDS = "surt string, seq long, page_id long, file string, offset long, length long"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, n long"


def surt(url: str | None) -> str:
    """Sort key of a url: host labels reversed, then the rest, as in ``com,example)/path``. Without ``://`` the url itself."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return url or ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]


def opened(root: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow.fs import FileSystem
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return FileSystem.from_uri(root)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None,
           payload: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member of its own. A revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {quote(url or '', safe=''':/?#[]@!$&'()*+,;=%~-._''')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> dict:
    """What a record says of its page. A response's size and digest are taken anew from its payload; if they differ from
    its header the archive is damaged."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda field: field[len("<urn:page:"):-1]
    own = number(fields["WARC-Record-ID"])
    return {"page_id": None if own == "null" else int(own), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"],
            "refers_to": int(number(fields["WARC-Refers-To"])) if "WARC-Refers-To" in fields else None}


def duplicates(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that revisit: of equal payloads of at least ``least_bytes`` that with the
    largest page_id is the response. Rows that share that id are responses all."""
    thin = materialise(pages.select("page_id", _sha().alias("sha"), F.octet_length(_html()).alias("size"))
                       .where(F.col("size") >= least_bytes).select("page_id", "sha"))
    largest = thin.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return (thin.join(largest, "sha").where("refers_to is not null and not (page_id <=> refers_to)")
            .select("page_id", "sha", "refers_to").distinct())


def _html() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def _sha() -> Column:
    return F.sha1(_html().cast("binary"))


def write(pages: DataFrame, root: str, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write the records of ``pages`` below ``root``, a folder all executors reach. Returns the table of records and the
    index directory, both written. Files of tasks that were repeated stay unused: the tables name those that count."""
    rows = _with_reference(pages, small(materialise(duplicates(pages, least_bytes))))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(root)
        fs.create_dir(base, recursive=True)
        out, path, offset, seq = None, "", 0, 0
        for batch in batches:
            entries = []
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                page_id = None if pd.isna(page_id) else int(page_id)
                target = None if pd.isna(refers_to) else int(refers_to)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = record("response" if target is None else "revisit", page_id, url, base32_sha1(payload),
                                len(payload), target, payload)
                out.write(member)
                entries.append((surt(url), seq, page_id, path, offset, len(member)))
                offset, seq = offset + len(member), seq + 1
            yield _frame(entries, RECORDS)
        if out is not None:
            out.close()

    records = materialise(rows.mapInPandas(archive, RECORDS))
    return records, materialise(index(records, root))


def _with_reference(pages: DataFrame, again: DataFrame) -> DataFrame:
    own = again.select(F.col("page_id").alias("__id"), F.col("sha").alias("__again"), "refers_to")
    keyed = pages.select("page_id", "url", "html", _sha().alias("__sha"))
    return keyed.join(own, (F.col("__sha") == F.col("__again")) & F.col("page_id").eqNullSafe(F.col("__id")), "left").select(
        F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))  # numbers beside nulls lose digits in pandas


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a frame whose whole numbers stay exact beside nulls."""
    kinds = [c.split() for c in schema.split(", ")]
    return pd.DataFrame({name: pd.array([r[i] for r in rows], "Int64" if kind == "long" else object)
                         for i, (name, kind) in enumerate(kinds)})


def index(records: DataFrame, root: str) -> DataFrame:
    """The capture index: entries in order of their reversed-host key, in compressed blocks; the result is the sparse
    directory, a row for each block."""
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(root)
        fs.create_dir(base, recursive=True)
        path, out, offset, held = f"{uuid.uuid4().hex}.cdx", None, 0, []

        def flush() -> tuple:
            nonlocal out, offset, held
            if out is None:
                out = fs.open_output_stream(f"{base}/{path}", compression=None)
            data = zlib.compress("\n".join(json.dumps(e) for e in held).encode())
            out.write(data)
            row = (held[0][0], held[-1][0], path, offset, len(data), len(held))
            offset, held = offset + len(data), []
            return row

        for batch in batches:
            done = []
            for e in batch[["surt", "file", "offset", "length"]].itertuples(index=False, name=None):
                held.append(e)
                if len(held) == BLOCK_ENTRIES:
                    done.append(flush())
            yield _frame(done, DIRECTORY)
        if held:
            yield _frame([flush()], DIRECTORY)
        if out is not None:
            out.close()

    order = ["surt", "file", "offset"]
    return records.select("surt", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(
        blocks, DIRECTORY)


def _block(fs, base: str, file: str, offset: int, length: int) -> list[list]:
    with fs.open_input_file(f"{base}/{file}") as f:
        f.seek(offset)
        return [json.loads(line) for line in zlib.decompress(f.read(length)).decode().split("\n")]


def _members(fs, base: str, entries: list[list]) -> Iterator[bytes]:
    """The records of index entries, neighbours in a file read in one piece."""
    entries = sorted(entries, key=lambda e: (e[1], e[2]))
    at = 0
    while at < len(entries):
        _, file, start, length = entries[at]
        end, upto = start + length, at + 1
        while (upto < len(entries) and entries[upto][1] == file and entries[upto][2] <= end + GAP_BYTES
               and entries[upto][2] + entries[upto][3] - start <= READ_BYTES):
            end, upto = max(end, entries[upto][2] + entries[upto][3]), upto + 1
        with fs.open_input_file(f"{base}/{file}") as f:
            f.seek(start)
            data = f.read(end - start)
        for _, _, offset, size in entries[at:upto]:
            yield data[offset - start:offset - start + size]
        at = upto


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def wanted(asked: DataFrame, directory: DataFrame) -> DataFrame:
    """(file, offset, length, keys): the index blocks whose key range holds keys of ``asked`` (surt), each with at most
    BLOCK_ENTRIES of those keys in order; a block with more of them has several rows.

    Block starts and keys are range-sorted together, so the block a key falls into is the number of starts up to it. A key
    that also ends blocks before that one goes on to all of these. No key meets a block it cannot be in."""
    starts = directory.select(F.col("first_key").alias("surt"), F.lit(1).alias("opens"), "last_key", "file", "offset", "length")
    keys = asked.select("surt", F.lit(0).alias("opens")).distinct()
    placed = materialise(running(materialise(starts.unionByName(keys, allowMissingColumns=True)), [],
                                 [F.col("surt"), F.col("opens").desc(), F.col("last_key")], "opens"))
    blocks = placed.where("opens = 1").select(F.col("before").alias("block"), "last_key", "file", "offset", "length")
    ended = blocks.groupBy(F.col("last_key").alias("surt")).agg(F.min("block").alias("since"))
    pairs = placed.where("opens = 0 and before > 0").join(ended, "surt", "left").select(
        "surt", F.floor(F.col("rank") / BLOCK_ENTRIES).alias("some"),
        F.explode(F.sequence(F.coalesce("since", F.col("before") - 1), F.col("before") - 1)).alias("block"))
    return materialise(pairs.join(blocks, "block").where("surt <= last_key").groupBy("block", "some", "file", "offset", "length")
                       .agg(F.sort_array(F.collect_list("surt")).alias("keys")).select("file", "offset", "length", "keys"))


def _entries(block: list[list], keys: list[str]) -> Iterator[list]:
    """The entries of a block under the sorted ``keys``, each found by binary search."""
    upto = 0
    for key in keys:
        since = bisect.bisect_left(block, key, lo=upto, key=lambda e: e[0])
        upto = bisect.bisect_right(block, key, lo=since, key=lambda e: e[0])
        yield from block[since:upto]


def captures(asked: DataFrame, directory: DataFrame, root: str) -> DataFrame:
    """The records under the keys ``asked`` (surt; repeated ones count once), by key range, binary search and range reads.
    Keys without a record give none, a key of many records is spread by its blocks."""
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(root)
        for batch in batches:
            for b in batch.itertuples(index=False):
                entries = _entries(_block(fs, base, b.file, int(b.offset), int(b.length)), list(b.keys))
                yield _frame([tuple(parsed(m).values()) for m in _members(fs, base, list(entries))], PAGES)

    pieces = wanted(asked, directory)
    # A row is small but stands for a block of records, so the number of tasks follows the rows.
    tasks = max(1, -(-pieces.count() // BLOCKS_PER_TASK))
    return pieces.repartition(tasks).mapInPandas(found, PAGES)


def lookup(directory: DataFrame, root: str, urls: DataFrame) -> DataFrame:
    """The captures of ``urls`` (url), in no order. Urls that differ only in the case of the host share a key."""
    key = F.udf(surt, "string")
    return captures(urls.select(key("url").alias("surt")), directory, root)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives below the shared folder and look all their keys up in the index: page_id, payload_bytes,
    payload_digest, record_type, refers_to for each row.

    A null html is an empty payload, a null url an empty target, a null page_id a record without a number, which revisits
    only others' numbers; repeated rows give a record each; other columns are ignored. An empty table gives no file."""
    root = new_dir(spark, "warc")
    records, directory = write(pages, root, least_bytes)
    return captures(records.select("surt"), directory, root)
