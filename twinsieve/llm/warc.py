"""WARC archives with the index first: offset, length, URL and digest of every record, then coalesced range reads.

Writing: a task writes its rows as one archive of gzip members, a record a member, and gives an index row for each.
Archives are written whole, under a name that each attempt of a task has to itself and that its index rows tell, so an
attempt that is lost, or one of two that run at once, leaves at most a file that no index row names.  Reading:
the selected index rows are sorted by (file, offset) within byte chunks of CHUNK, neighbours are joined to one range
read when the gap is small, and each member is parsed alone.

Of records with equal payloads (equal SHA-1 digests; bytes are not compared) of at least `min_bytes` bytes, that with the
largest id is a response and the others are revisits that name it (a null id is the smallest; rows that repeat the
largest id are all responses).  Null payloads are empty; payloads of any length are written whole.  Empty tables give no
archives and an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import filesystem, fresh, put, stash

CHUNK = 8 << 20
GAP = 64 << 10
MIN_BYTES = 1000
#: The filter of repeated digests is FILTER_ROWS pieces of ROW_BITS bits at most (8 MB, broadcast): BITS_EACH bits a digest up to a
#: million of them, so that 1 in BITS_EACH of the other rows passes; beyond, more pass, and are dealt with in the same way.
FILTER_ROWS, ROW_BITS, BITS_EACH = 2_048, 32_768, 64
#: Bytes of archives that one task reads.
TASK_BYTES = 32 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


RECORD = ("id", "url", "body", "digest", "record_type", "refers_to", "payload_bytes")


def _marked(rows: DataFrame, repeated: DataFrame, long_enough) -> DataFrame:
    """rows with may_repeat: whether a digest may be among `repeated` (same), told by a filter that is sized by their number."""
    c = F.col
    pieces = min(FILTER_ROWS, max(1, -(-repeated.count() * BITS_EACH // ROW_BITS)))
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(pieces * ROW_BITS))
    bits = repeated.select(F.floor(place("same") / ROW_BITS).cast("int").alias("piece"), (place("same") % ROW_BITS).alias("bit"))
    bits = bits.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))  # FILTER_ROWS rows of 4 KB at most
    at = place("digest")
    byte = F.conv(F.hex(F.substring(c("bits"), (at % ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    piece = F.when(long_enough, F.floor(at / ROW_BITS).cast("int"))
    return rows.withColumn("piece", piece).join(F.broadcast(bits), "piece", "left").withColumn("may_repeat", F.coalesce(hit, F.lit(False))).drop("piece", "bits")


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """RECORD: id, url, body (binary; empty for a revisit), digest, record_type, refers_to, payload_bytes: which record stands for
    its payload."""
    c = F.col
    rows = pages.select(
        c(page_id).cast("long").alias("id"), c(url).cast("string").alias("url"), F.coalesce(F.encode(c(payload), "UTF-8"), F.lit(b"")).alias("body")
    )
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("payload_bytes", F.octet_length("body").cast("long"))
    long_enough = F.octet_length("body") >= min_bytes
    first = rows.where(long_enough).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    first = stash(first.where("n > 1").select(c("digest").alias("same"), c("first")), "warc_repeated")
    marked = _marked(rows, first, long_enough)
    alone = marked.where("not may_repeat").select(*RECORD[:4], F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_bytes")
    # Verdicts are made on slim rows, a row for each (id, digest); bodies meet them by both, so a payload of any number of
    # pages is spread over tasks, and those of revisits go no further.
    some = marked.where("may_repeat").withColumn("key", F.coalesce("id", F.lit(0)))
    slim = some.select("id", "key", "digest").distinct().join(first, c("digest") == c("same"), "left")
    revisit = c("same").isNotNull() & c("first").isNotNull() & ~c("id").eqNullSafe(c("first"))
    slim = slim.select("key", "digest", c("id").isNull().alias("no_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, c("first")).alias("refers_to"))
    joined = some.withColumn("no_id", c("id").isNull()).join(slim, ["key", "no_id", "digest"])
    joined = joined.withColumn("body", F.when(c("record_type") == "response", c("body")).otherwise(F.lit(b"")))
    return alone.select(*RECORD).unionByName(joined.select(*RECORD))


def record(page_id: int | None, url: str, body: bytes, digest: str, kind: str, refers_to: int | None, payload_bytes: int | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member.  A revisit has the digest and size of the payload but not the payload."""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(body) if payload_bytes is None else payload_bytes}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + body
    raw = ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(records: DataFrame, base: str) -> DataFrame:
    """The index (INDEX) of the archives, one of each partition of `records` (columns of `classify`) that has rows."""

    def run(batches):
        index, uri, offset = [], f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0

        def members() -> Iterator[bytes]:
            nonlocal offset
            for batch in batches:
                cols = [batch.column(i) for i in range(7)]
                for row in zip(*(x.to_pylist() for x in cols), strict=True):
                    page_id, url, _, digest, kind, ref, size = row
                    member = record(*row)
                    index.append((page_id, url, digest, size, kind, ref, uri, offset, len(member)))
                    offset += len(member)
                    yield member

        got = members()
        first = next(got, None)
        if first is None:
            return
        put(uri, (x for part in ((first,), got) for x in part))
        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for i in range(0, len(index), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*index[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)

    return stash(records.mapInArrow(run, INDEX), "warc_index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = CHUNK) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, positions in rows) of the reads for rows (file, offset, length) sorted by file and offset."""
    at = 0
    while at < len(rows):
        file, start, n = rows[at]
        end, own = start + n, [at]
        while (at := at + 1) < len(rows) and rows[at][0] == file and rows[at][1] <= end + gap and rows[at][1] + rows[at][2] <= start + most:
            end = max(end, rows[at][1] + rows[at][2])
            own.append(at)
        yield file, start, end, own


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to (and the payload) of the records that `index`, or any
    selection of its rows, names.  A response's size and digest are taken from the payload that was read."""
    want = index.select("file", "offset", "length").withColumn("chunk", F.floor(F.col("offset") / CHUNK))
    total = want.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    want = want.repartition(max(1, -(-total // TASK_BYTES)), "file", "chunk").sortWithinPartitions("file", "offset")
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            out, open_uri, handle = [], None, None
            for file, start, end, own in ranges(rows):
                if file != open_uri:
                    if handle is not None:
                        handle.close()
                    system, path = filesystem(file)
                    open_uri, handle = file, system.open_input_file(path)
                data = handle.read_at(end - start, start)
                for i in own:
                    fields, body = parse(data[rows[i][1] - start : rows[i][1] - start + rows[i][2]])
                    number = lambda k, f=fields: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", f.get(k, ""))) else None
                    kind, whole = fields["WARC-Type"], fields["WARC-Type"] == "response"
                    digest = hashlib.sha1(body).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    out.append((number("WARC-Record-ID"), fields["WARC-Target-URI"], len(body) if whole else int(fields["X-Payload-Length"]), digest, kind, number("WARC-Refers-To"), body))
            if handle is not None:
                handle.close()
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
            names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    return want.drop("chunk").mapInArrow(run, schema)


def archive(pages: DataFrame, base: str | None = None, **how) -> DataFrame:
    """Write one record for each of pages; the index of all archives."""
    return write_archives(classify(pages, **how), base or fresh(pages.sparkSession, "warc"))


def op9_warc(spark, sf_dir: str) -> DataFrame:
    index = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest AS same, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN f ON digest = same
"""
