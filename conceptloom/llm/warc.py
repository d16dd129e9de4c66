"""Deterministic sharded WARC writer, and a reader.

Records are range-sorted on exact bounds of the id, so the same rows give the same files whatever the cluster. A task
writes its shards as gzip members, one a record, starts a new file once the compressed size passes a bound, and writes
each file under a name of its own attempt before renaming it. The files of the attempts that Spark accepts are listed in
a manifest; readers follow the manifest only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Records of a shard about; compressed bytes after which a file is closed; date of all records, as the input has none.
SHARD_ROWS, FILE_BYTES, DATE = 20_000, 64 << 20, "1970-01-01T00:00:00Z"
#: Buckets of an id range that are counted at once.
GRID = 4096
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict, payload: bytes, date: str = DATE) -> bytes:
    """A record's gzip member: headers and digests made anew, without a time stamp of the run."""
    revisit = row["kind"] == "revisit"
    block = b"" if revisit else HTTP % len(payload) + payload
    headers = {
        "WARC-Type": row["kind"],
        "WARC-Record-ID": f"<{row['urn']}>",
        "WARC-Target-URI": quote(row["url"] or "", safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{row['refers_urn']}>"}
    headers |= {"X-Payload-Length": str(len(payload)), "X-Page-ID": "" if row["id"] is None else str(row["id"])}
    if row["refers"] is not None:
        headers["X-Refers-To-Page-ID"] = str(row["refers"])
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, compresslevel=5, mtime=0)


def records(stream: io.BufferedIOBase, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, one gzip member at a time."""
    left = b""
    while True:
        if not left and not (left := stream.read(chunk)):
            return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not left and not (left := stream.read(chunk)):
                raise EOFError("the file ends within a record")
            out.append(z.decompress(left))
            left = z.unused_data
        data = b"".join(out)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])
        if rest[n:] != b"\r\n\r\n" or f"sha1:{digest(rest[:n])}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
        yield headers, rest[:n]


def _cell(full: list[tuple[int, int, int]], widths: list[int], each: int):
    """The number of the grid cell an id falls in, or -1 between the ranges."""
    low, high = (np.array(x, np.int64) for x in ([f[0] for f in full], [f[1] - 1 for f in full]))
    wide = np.array(widths, np.uint64)

    @F.arrow_udf("long")
    def cell(i: pa.Array) -> pa.Array:
        v = i.to_numpy(zero_copy_only=False).astype(np.int64)
        k = np.searchsorted(low, v, side="right") - 1
        past = (v.view(np.uint64) - low[k].view(np.uint64)) // wide[k]  # wraps rightly for ranges beyond 2^63
        return pa.array(np.where(v <= high[k], k * each + past.astype(np.int64), -1), pa.int64())

    return cell


def range_bounds(ids: DataFrame, rows: int = SHARD_ROWS, grid: int = GRID) -> list[int]:
    """Upper bounds (exclusive) of id ranges of about rows rows each, from exact counts of ids(id).

    The range of ids is counted on a grid; a cell over the bound is counted on a finer grid, down to single ids. Each pass
    reads the ids only and returns at most grid counts for each range still too full; ranges too full are counted together.
    """
    lo, hi, n = ids.agg(F.min("id"), F.max("id"), F.count("id")).head()
    if not n:
        return []
    cells: list[tuple[int, int, int]] = []
    full = [(lo, hi + 1, n)]
    while full:
        a, b = full[0][0], full[-1][1]
        each = max(2, grid // len(full))
        widths = [-(-(y - x) // each) for x, y, _ in full]

        cell = _cell(full, widths, each)
        found = ids.where(F.col("id").between(a, b - 1)).select(cell("id").alias("c")).where("c >= 0").groupBy("c").agg(F.count("*").alias("n"))
        next_full = []
        for r in sorted(found.toLocalIterator()):
            k, j = divmod(r["c"], each)
            x, w = full[k][0] + j * widths[k], widths[k]
            (next_full if r["n"] > rows and w > 1 else cells).append((x, min(x + w, full[k][1]), r["n"]))
        full = next_full
    bounds, inside = [], 0
    for x, y, c in sorted(cells):
        if inside and inside + c > rows:
            bounds.append(x)
            inside = 0
        inside += c
        del y
    return bounds


def write(pages: DataFrame, out: str, min_payload: int = 0, shard_rows: int = SHARD_ROWS, file_bytes: int = FILE_BYTES, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as WARC files under out, a URI that all executors reach, and returns the manifest's rows.

    A null html is an empty payload, a null url an empty target that is not the empty url; repeated rows and ids are
    records of their own, ids are whole 64-bit numbers, and an empty table gives a manifest without files. out/manifest
    has the files, and exists only once all of them are in place. Other columns of pages, of whatever names, are not read.
    """
    spark = pages.sparkSession
    common.bounded_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    id_, url = F.col(id_col).cast("long"), F.col(url_col).cast("string")
    d = pages.select(id_.alias("id"), url.alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("sha"))
    # the response of each payload: the largest id (null below all), of equal ids the null url, then the least
    order = F.struct(F.col("id").isNull().alias("a"), (-F.col("id").cast("decimal(20,0)")).alias("b"), F.col("url").isNotNull().alias("c"), "url", "id")
    slim = common.materialize(d.select("id", "url", "sha", F.octet_length("html").alias("bytes")), "payloads")
    first = slim.where(F.col("bytes") >= min_payload).groupBy("sha").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
    first = common.materialize(first.select("sha", F.col("o.id").alias("refers"), F.col("o.url").alias("refers_url"), F.lit(True).alias("shared")), "responses")
    bounds = range_bounds(slim.select("id"), shard_rows)
    shards = len(bounds) + 1
    edges = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def shard(i: pa.Array) -> pa.Array:
        known = pc.is_valid(i).to_numpy(zero_copy_only=False)
        to = np.searchsorted(edges, pc.fill_null(i, 0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(known, to, 0).astype(np.int32))

    # ids without number and ids met very often are spread over pieces of their shard by the payload's hash
    heavy = slim.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows)
    heavy = common.materialize(heavy.select(F.col("id").alias("heavy"), F.ceil(F.col("n") / F.lit(shard_rows)).alias("pieces")), "heavy")
    many, pieces = heavy.agg(F.count("*"), F.coalesce(F.max("pieces"), F.lit(0))).head()
    # few ids can be so heavy; their table is broadcast while it has under 1000 rows, and joined by a shuffle beyond
    d = d.join(F.broadcast(heavy) if many < 1000 else heavy, d["id"].eqNullSafe(heavy["heavy"]), "left")
    piece = F.coalesce(F.pmod(F.xxhash64("sha", "url"), F.col("pieces")), F.lit(0)).cast("int")
    d = d.join(first, "sha", "left").select("id", "url", "html", "sha", "refers", "refers_url", F.coalesce("shared", F.lit(False)).alias("shared"), shard("id").alias("shard"), piece.alias("piece"))
    # a shard is a task: shard numbers are partition numbers, and the pieces of a crowded shard go to the next ones
    tasks = int(max(1, shards, pieces))
    d = d.repartitionById(tasks, F.pmod(F.col("shard") + F.col("piece"), F.lit(tasks)).cast("int"))
    d = d.sortWithinPartitions("shard", "piece", F.col("id").asc_nulls_first(), F.col("url").asc_nulls_first(), "sha")
    attempt_root = f"{out}/_temporary"

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        _, temp = pafs.FileSystem.from_uri(attempt_root)
        temp = f"{temp}/{uuid.uuid4().hex}"
        fs.create_dir(temp)
        open_file = name = None
        size = count = number = 0
        sha = hashlib.sha256()
        at, before, same, told = None, None, 0, []

        def close():
            nonlocal open_file, number
            open_file.close()
            fs.move(f"{temp}/{name}", f"{root}/{name}")
            told.append({"file": name, "bytes": size, "records": count, "sha256": sha.hexdigest()})
            open_file, number = None, number + 1

        for b in it:
            columns = (b.column(k).to_pylist() for k in range(b.num_columns))
            for i, url, page, digest_, refers, refers_url, shared, k, p in zip(*columns, strict=True):
                if (k, p) != at:
                    if open_file:
                        close()
                    at, number = (k, p), 0
                same = same + 1 if (i, url, digest_) == before else 0
                before = (i, url, digest_)
                response = not shared or ((i, url) == (refers, refers_url) and not same)
                row = {"kind": "response" if response else "revisit", "urn": _urn(i, url, digest_, same), "url": url, "id": i, "refers": None if response else refers, "refers_urn": _urn(refers, refers_url, digest_)}
                data = record(row, page.encode("utf-8", "surrogatepass"), date)
                if open_file is None:
                    name, size, count, sha = f"part-{k:06d}-{p:04d}-{number:05d}.warc.gz", 0, 0, hashlib.sha256()
                    open_file = fs.open_output_stream(f"{temp}/{name}", compression=None)
                open_file.write(data)
                sha.update(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    close()
            if told:
                yield pa.RecordBatch.from_pylist(told, MANIFEST)
                told.clear()
        if open_file:
            close()
        if told:
            yield pa.RecordBatch.from_pylist(told, MANIFEST)

    manifest = d.mapInArrow(save, FILES)
    manifest.write.json(f"{out}/manifest")
    common.delete(spark, attempt_root)
    return spark.read.schema(FILES).json(f"{out}/manifest")


FILES = "file string, bytes long, records long, sha256 string"
MANIFEST = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _urn(page: int | None, url: str | None, sha: str, times: int = 0) -> str:
    """The name of a record: of its id, its url (a null one is not the empty one), its payload and how often these were met before."""
    link = hashlib.sha256((("" if url is None else f"={url}") + sha).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return f"urn:page:{'' if page is None else page}:{link}{f':{times}' if times else ''}"


def read(spark: SparkSession, out: str) -> DataFrame:
    """A row for each record of the files of out's manifest: the record's headers and its payload (null for revisits)."""
    common.bounded_batches(spark)
    files = spark.read.schema(FILES).json(f"{out}/manifest")
    files = files.select("file", "records").repartition(max(1, spark.sparkContext.defaultParallelism, files.count()), "file")

    def load(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        number = lambda x: int(x) if x else None
        for b in it:
            for name, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, size, met = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, block in records(f):
                        met += 1
                        payload = None
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if f"sha1:{digest(payload)}" != h["WARC-Payload-Digest"] or len(payload) != int(h["X-Payload-Length"]):
                                raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
                        rows.append((number(h["X-Page-ID"]), h["WARC-Target-URI"], h["WARC-Type"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), number(h.get("X-Refers-To-Page-ID")), payload))
                        size += len(block)
                        if size > common.BATCH_BYTES or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, size = [], 0
                if met != expected:
                    raise ValueError(f"{name} has {met} records; the manifest says {expected}")
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(load, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORDS, strict=True)], schema=RECORDS)


def summary(manifest: DataFrame) -> str:
    """The manifest's totals as JSON."""
    n, b, r = manifest.agg(F.count("*"), F.sum("bytes"), F.sum("records")).head()
    return json.dumps({"files": n, "bytes": b or 0, "records": r or 0})
