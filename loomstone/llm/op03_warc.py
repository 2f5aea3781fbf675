"""Deterministic sharded WARC writer and reader.

Payload digests are taken in the JVM, and of equal payloads of at least `least` bytes the row of the largest page_id
becomes the response, the others revisits. Only the light rows (page_id, digest) meet for that, in salted parts; a
revisit's mark then travels into the range sort beside the pages themselves, so the pages are shuffled once and are
joined with nothing. The ranges follow from exact counts: page_ids are counted in CELLS cells of equal width, cells
that hold more than a range may are counted in finer cells, and consecutive cells make ranges; their number follows from
the bytes of all payloads. So ranges are a function of the input, whatever the cluster or the sampling. Each range is
sorted and written in gzip members of a record; a file rolls when its compressed size passes `roll` bytes. A file is
written under a temporary name of the task attempt and renamed when it is whole; names and bytes depend on the input
alone, so a repeated task brings the same bytes to the same name, and where a store refuses to rename onto it, the
whole file that is there stays. The rows of the manifest are committed by Spark with the task that wrote the files;
readers take files from the manifest only, and what dead attempts left goes with the temporary folder. Headers
(Content-Length, block and payload digests, record ids, date) are made anew and checked on reading.

Defined cases: null html is an empty payload; null url becomes urn:page:<page_id>; a null page_id is smaller than
any; rows that tie on page_id and payload are all responses, or all revisits, with equal record ids; the rows of one
page_id are one range; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, read_table, shared_dir

ROLL, LEVEL, SALTS, DATE, LEAST, CELLS, RANGE_BYTES, RANGES = 16 << 20, 4, 16, "2024-01-01T00:00:00Z", 0, 4096, 8 << 20, 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, digest string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC record."""
    digest = _base32(hashlib.sha1(payload).digest())
    url = f"urn:page:{page_id}" if url is None else "".join(f"%{ord(c):02X}" if c <= " " else c for c in url)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest + '+' * revisit)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises if a length or digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n" or f"sha1:{_base32(hashlib.sha1(block).digest())}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and f"sha1:{_base32(hashlib.sha1(payload).digest())}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    return fields, payload


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, uncompressed."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            part = view[at : at + 32768]
            if not len(part):
                raise ValueError("cut off inside a record")
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def settle(store, temporary: str, name: str, size: int) -> None:
    """Give a whole file its name. If an earlier attempt's whole file has it and the store keeps that, so do we: the bytes are the same."""
    from pyarrow import fs

    try:
        store.move(temporary, name)
    except OSError:
        there = store.get_file_info(name)
        if there.type != fs.FileType.File or there.size != size:
            raise
        store.delete_file(temporary)


def cells(counted: DataFrame, most: int) -> list[tuple[int, int]]:
    """(first page_id, rows) of cells in ascending order, of counted(page_id, n); a cell of more than `most` rows is one page_id. CELLS rows a cell that is cut come to the driver."""
    ends = counted.agg(F.min("page_id"), F.max("page_id")).first()
    if ends[0] is None:
        return []
    done: list[tuple[int, int]] = []
    todo = [(ends[0], ends[1])]
    while todo:
        now, todo = todo[:64], todo[64:]
        x = None
        for low, high in now:
            width = -(-(high - low + 1) // CELLS)
            # page_id - low can pass 63 bits, a decimal cannot
            part = counted.filter(F.col("page_id").between(low, high)).select(F.lit(low).alias("low"), F.floor((F.col("page_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long").alias("cell"), "n")
            x = part if x is None else x.unionByName(part)
        for low, cell, n in x.groupBy("low", "cell").agg(F.sum("n")).collect():
            high = next(h for a, h in now if a == low)
            width = -(-(high - low + 1) // CELLS)
            first, last = low + cell * width, min(high, low + (cell + 1) * width - 1)
            if n > most and first < last:
                todo.append((first, last))
            else:
                done.append((first, n))
    return sorted(done)


def ranges(counted: DataFrame, rows: int, n: int) -> list[int]:
    """First page_ids of at most n + 1 ranges of about rows / n rows."""
    most, starts, have = max(1, rows // n), [], 0
    for first, k in cells(counted, most):
        if not starts or have + k > most:
            starts.append(first)
            have = 0
        have += k
    return starts


def _range_of(page_id, starts: list[int]):
    """Number of the range from 0; null in the first. A binary search in a literal array."""
    if len(starts) < 2:
        return F.lit(0)
    array, low, high = F.array(*[F.lit(s) for s in starts]), F.lit(0), F.lit(len(starts))
    steps = F.sequence(F.lit(1), F.lit(len(starts).bit_length()))

    def step(s, _):
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(array, mid) <= page_id
        wide = s["high"] - s["low"] > 1
        return F.struct(F.when(wide & below, mid).otherwise(s["low"]).alias("low"), F.when(wide & ~below, mid).otherwise(s["high"]).alias("high"))

    return F.coalesce(F.when(page_id.isNotNull(), F.aggregate(steps, F.struct(low.alias("low"), high.alias("high")), step, lambda s: s["low"])), F.lit(0))


def write(pages: DataFrame, root: str, roll: int = ROLL, least: int = LEAST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) below root; the manifest, as written."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    every = scratch.keep(full.select("page_id", "digest", F.octet_length("html").alias("bytes"), salt.alias("salt")), "digests")
    light = every.filter(F.col("bytes") >= least)
    best = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    revisits = light.join(best, ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to").distinct()
    total, size = every.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    starts = ranges(every.filter("page_id IS NOT NULL").select("page_id", F.lit(1).alias("n")), total, min(RANGES, -(-(size or 1) // range_bytes)))
    rows = full.withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits).withColumn("part", _range_of(F.col("page_id"), starts))
    rows = rows.repartitionById(max(1, len(starts)), F.col("part")).sortWithinPartitions("part", "page_id", F.col("refers_to").isNull(), "digest", "url").select("part", "page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(f"{base}/temporary", recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple] = []
        body, count, file, part, marks, marks_of = bytearray(), 0, 0, None, {}, object()

        def close() -> None:
            nonlocal body, count, file
            if count:
                name, temporary = f"part-{part:05d}-{file:05d}.warc.gz", f"{base}/temporary/{part:05d}-{file:05d}-{attempt}"
                with store.open_output_stream(temporary, compression=None) as out:
                    out.write(bytes(body))
                settle(store, temporary, f"{base}/{name}", len(body))
                done.append((f"{root}/{name}", count, len(body), _base32(hashlib.sha1(body).digest())))
                file += 1
            body, count = bytearray(), 0

        for b in batches:
            for p, page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    close()
                    file, part = 0, p
                if page_id != marks_of:
                    marks, marks_of = {}, page_id
                if html is None:
                    marks[digest] = refers_to
                    continue
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                body += z.compress(record(page_id, url, html.encode(), marks.get(digest), digest in marks)) + z.flush()
                count += 1
                if len(body) >= roll:
                    close()
        close()
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], ["file", "records", "bytes", "digest"])

    path = f"{root}/manifest"
    rows.mapInArrow(run, MANIFEST).write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/temporary")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    scratch.drop(every)
    return spark.read.schema(MANIFEST).parquet(path)


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files; a file is one unit of work. payloads=False leaves the bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, records, size, digest in zip(*(c.to_pylist() for c in b.columns)):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                if len(data) != size or _base32(hashlib.sha1(data).digest()) != digest:
                    raise ValueError(f"{name} is not the file of the manifest")
                rows, seen, held = [], 0, 0
                for raw in members(data):
                    h, payload = parse(raw)
                    number = lambda k: int(h[k]) if h.get(k) else None
                    rows.append((number("X-Page-Id"), h["WARC-Target-URI"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], h["WARC-Type"], number("X-Refers-To-Page"), payload if payloads and h["WARC-Type"] == "response" else None))
                    seen, held = seen + 1, held + len(payload)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield _records(rows)
                        rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records, not {records}")
                if rows:
                    yield _records(rows)

    spark = manifest.sparkSession
    n = min(max(1, manifest.count()), 8 * spark.sparkContext.defaultParallelism)
    return manifest.repartition(n).mapInArrow(run, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/loomstone-warc-{uuid.uuid4().hex}"
    manifest = write(read_table(spark, sf_dir, "pages"), root)
    return read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
