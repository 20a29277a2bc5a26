"""WARC archives, and their index by an external merge of sorted runs.

Writing: every partition sorts its captures by URL key, time and id and writes them as gzipped
WARC files through Spark's text writer (a record is text, and records end with an empty line).
Of captures with equal payloads of at least `revisit_bytes`, the one with the smallest id is a
response and the others are revisits that refer to it.

Reading: a task decompresses an archive as a stream, checks each response against its digest
and lists its records: one sorted run of captures per archive. Runs are cut at shared range
boundaries; the pieces of a range meet in one task, where a loser tree merges them, so that the
partitions in their order hold all captures by URL key, time and id.

Defined cases: a null payload is empty; a null URL is empty; control characters and spaces in
URLs become %20; a null id neither revisits nor is revisited; rows that repeat an id repeat its
record; an empty table gives no archive and an empty index; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.util import only, save
from chatloom.session import scratch_path, ship_package

END = "\r\n\r\n"
_RECORDS = ("id string, url string, ts string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
            "archive string, seq long, offset long")


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, then path and query, lower case, without fragment and scheme."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
    host = F.lower(F.regexp_extract(url, scheme + r"([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, scheme + r"[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(rest))


def captures(pages: DataFrame, ident: str, url: str, payload: str, ts: Column | None = None, revisit_bytes: int = 100) -> DataFrame:
    """id, url, url_key, ts, payload, payload_bytes, payload_digest and, for revisits, refers_to."""
    own = only(pages, ident, url, payload).toDF("id", "url", "payload")
    own = own.select(
        "id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.date_format(ts if ts is not None else F.lit("2024-01-01").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.coalesce("payload", F.lit("")).alias("payload"))
    own = own.withColumn("url_key", url_key(F.col("url"))).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha2("payload", 256))
    large = own.where((F.col("payload_bytes") >= revisit_bytes) & F.col("id").isNotNull())
    # only digests that stand more than once: counted where read, then once per digest
    first = save(large.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("payload_digest").alias("digest"), "first"), "warc-first")
    # small payloads get keys of their own, so that they spread
    key = F.when((F.col("payload_bytes") >= revisit_bytes) & F.col("id").isNotNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string")))
    return (own.withColumn("digest", key).join(first, "digest", "left").withColumn("refers_to", F.when(F.col("first") != F.col("id"), F.col("first")))
            .drop("digest", "first"))


def record(c: DataFrame) -> Column:
    """A capture as a WARC record without the empty line that ends it."""
    crlf = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), c["payload_bytes"].cast("string"), F.lit(END))
    block = F.when(c["refers_to"].isNull(), F.concat(http, c["payload"])).otherwise(http)
    ident = F.coalesce(c["id"].cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(c["refers_to"].isNull(), "response").otherwise("revisit"), crlf,
        F.lit("WARC-Record-ID: <urn:capture:"), ident, F.lit(">\r\nWARC-Target-URI: "), c["url"], F.lit("\r\nWARC-Date: "), c["ts"], crlf,
        F.lit("WARC-Payload-Digest: sha256:"), c["payload_digest"], crlf,
        F.when(c["refers_to"].isNull(), "").otherwise(F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:capture:"),
            c["refers_to"].cast("string"), F.lit(">\r\n"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(caps: DataFrame, path: str, records_per_file: int = 5000) -> None:
    """Archives of at most `records_per_file` captures, each sorted by URL key, time and id."""
    run = caps.sortWithinPartitions("url_key", "ts", "id")
    run.select(record(run).alias("value")).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(path)


def _inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file of gzip members, in pieces."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            yield member.decompress(view[at:at + step])
            at += step
        if not member.eof:
            raise ValueError("truncated archive")
        at = min(at, len(view)) - len(member.unused_data)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers in lower case, block, offset in the inflated archive) of each record."""
    pieces, held, offset = _inflate(data), bytearray(), 0

    def fill(n: int) -> None:
        while len(held) < n:
            if (piece := next(pieces, None)) is None:
                raise ValueError("truncated record")
            held.extend(piece)

    while True:
        while not held:
            if (piece := next(pieces, None)) is None:
                return
            held.extend(piece)
        while (end := held.find(END.encode())) < 0:
            fill(len(held) + 1)
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {offset}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        fill(stop + 4)
        if held[stop:stop + 4] != END.encode():
            raise ValueError(f"record at {offset} does not end as its length says")
        yield headers, bytes(held[start:stop]), offset
        del held[:stop + 4]
        offset += stop + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, url, ts, type, reference, payload length and digest, archive, place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.strip().split(" ") for c in _RECORDS.split(","))])
        ident = lambda v: (v or "")[len("<urn:capture:"):-1] or None
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows = []
                for seq, (h, block, offset) in enumerate(read_records(data.as_buffer())):
                    head, _, payload = block.partition(END.encode())
                    length = int(next(x for x in head.decode().split("\r\n") if x.lower().startswith("content-length: "))[16:])
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"record at {offset} of {name} does not match its digest")
                    rows.append((ident(h["warc-record-id"]), h["warc-target-uri"], h["warc-date"], h["warc-type"], ident(h.get("warc-refers-to")),
                                 length, digest, name.as_py().rsplit("/", 1)[-1], seq, offset))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, _RECORDS)


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the root's winner is next."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.runs[a], self.runs[b]
        if self.at[b] >= len(y):
            return True
        if self.at[a] >= len(x):
            return False
        p, q = x[self.at[a]], y[self.at[b]]
        return (p, a) < (q, b)

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if not self._beats(winner, other):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) of all items in order."""
        while self.k and self.at[w := self.losers[0]] < len(self.runs[w]):
            yield w, self.at[w]
            self.at[w] += 1
            self._replay(w)


def merge_runs(index: DataFrame, keys: list[str], run: str = "archive", seq: str = "seq") -> DataFrame:
    """`index` ordered by `keys` over its partitions; each `run` of it is sorted by `keys` along `seq`.

    Rows keep their columns. A range holds about rows / shuffle partitions index rows, also where
    one URL has most of them, since the range keys are unique together.
    """
    names = index.columns

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        runs = table[run].combine_chunks().dictionary_encode()
        runs = runs.chunk(0) if isinstance(runs, pa.ChunkedArray) else runs
        code = runs.indices.to_numpy()
        order = np.lexsort((table[seq].to_numpy(), code))  # the pieces of the runs, as they were cut
        bounds = np.searchsorted(code[order], np.arange(len(runs.dictionary) + 1))
        key = list(zip(*[[(v is not None, v) for v in table[k].to_pylist()] for k in keys]))
        pieces = [order[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        tree = LoserTree([[key[i] for i in p] for p in pieces])
        out = table.take(pa.array([pieces[r][i] for r, i in tree], pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    ship_package(index.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(index.schema)
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartitionByRange(n, *keys).mapInArrow(merge, T.StructType([index.schema[c] for c in names]))


def archive_and_index(pages: DataFrame, ident: str, url: str, payload: str, ts: Column | None = None, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and returns the merged index (columns of `read_archives` and url_key)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(captures(pages, ident, url, payload, ts), path)
    kind = pages.schema[ident].dataType.simpleString()
    index = read_archives(spark, path).withColumn("url_key", url_key(F.col("url"))).withColumn("id", F.col("id").cast(kind)).withColumn(
        "refers_to", F.col("refers_to").cast(kind))
    return merge_runs(save(index, "warc-index"), ["url_key", "ts", "id"])
