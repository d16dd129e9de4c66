"""Shared pieces: text rules, the shared folder, materialised tables, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType
from pyspark.sql import functions as F

#: One or more characters that end a word: ASCII white space only.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of Arrow data sent to Python at once; very long documents then come in small batches.
BATCH_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as rows, so that a run of very long texts fits a Python worker; narrow rows keep large batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim(spark: SparkSession | None = None) -> None:
    """Gives memory that the driver's Python no longer uses back to the system, where the C library can.

    With a session its JVM collects too: plans are held until Python has let go of their frames.
    """
    gc.collect()
    if spark:
        spark._jvm.java.lang.System.gc()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only a local session without one gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='conceptloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Lists that recorded() fills.
_RECORDS: list[list[str]] = []


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Adds the paths of all tables that are written meanwhile to paths."""
    _RECORDS.append(paths)
    try:
        yield
    finally:
        _RECORDS.pop()


def sweep(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> None:
    """Deletes the tables at paths, but for those that reader still reads, and takes them off the list."""
    read = reader.inputFiles() if reader is not None else []
    for path in list(paths):
        if not any(path.rpartition("/")[2] in f for f in read):
            delete(spark, path)
            paths.remove(path)


def written(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> str:
    """Writes df as Parquet to a fresh path of the shared folder, and returns it."""
    path = fresh_path(df.sparkSession, label)
    for paths in _RECORDS:
        paths.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, so a lost executor costs a reread only."""
    spark = df.sparkSession
    path = written(df, label)
    out = spark.read.schema(df.schema).parquet(path)
    out._conceptloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table of materialize() that no later step reads."""
    if path := getattr(df, "_conceptloom_path", None):
        delete(df.sparkSession, path)


#: Two columns that say where a row stands: a hash of its file, and its number there. Rows of a file that are looked up together.
ADDRESS, CHUNK_BITS = ("__f", "__r"), 18


def addressed(docs: DataFrame, label: str = "rows") -> tuple[DataFrame, list[Column]]:
    """docs as a plain scan of Parquet files, and its address columns. What is no such scan yet is written once.

    Addresses are read from the files' metadata, so they are the same whenever and wherever a row is read again.
    """
    if _plain(docs):
        with contextlib.suppress(AnalysisException):
            return docs, _address(docs)
    docs = materialize(docs, label)
    return docs, _address(docs)


def _plain(docs: DataFrame) -> bool:
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def _address(docs: DataFrame) -> list[Column]:
    m = docs.metadataColumn("_metadata")
    found = [F.xxhash64(m["file_path"]).alias(ADDRESS[0]), m["row_index"].alias(ADDRESS[1])]
    docs.select(*found).schema  # noqa: B018 - raises where there is no such metadata
    return found


def attach(docs: DataFrame, table: DataFrame, label: str, columns: list[str] | None = None, make: tuple[StructType, Callable[[pa.RecordBatch], pa.RecordBatch]] | None = None) -> DataFrame:
    """Rows of docs (or some of its columns) whose address stands in table, with the table's other columns; docs is the scan that addressed() gave.

    A join without a shuffle of docs: the table, of one narrow row an address at most, is written in pieces by file and
    run of rows, and every task looks up the pieces of the rows it scans in the shared folder. make gives a schema and
    what makes rows of it from those found, in the same worker. The files that docs scans must not be rewritten meanwhile.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not _plain(docs):
        raise ValueError("attach() looks rows up in a plain scan, as addressed() gives it")
    address = _address(docs)
    docs = docs.select(*(docs[c] for c in columns or docs.columns), *address)
    values = [f for f in table.schema.fields if f.name not in ADDRESS]
    schema = StructType([*docs.schema.fields[:-2], *values])
    pieces = table.withColumn("__c", F.shiftright(ADDRESS[1], CHUNK_BITS)).repartition(ADDRESS[0], "__c")
    path = written(pieces, label, (ADDRESS[0], "__c"))

    def look_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        held: dict[tuple[int, int], tuple[np.ndarray, pa.Table] | None] = {}

        def piece(key: tuple[int, int]):
            if key not in held:
                while len(held) > 3:
                    del held[next(iter(held))]
                infos = fs.get_file_info(pafs.FileSelector(f"{root}/{ADDRESS[0]}={key[0]}/__c={key[1]}", allow_not_found=True))
                read = [pq.ParquetFile(fs.open_input_file(x.path)).read() for x in infos if x.path.endswith(".parquet")]
                t = pa.concat_tables(read).sort_by(ADDRESS[1]).combine_chunks() if read else None
                held[key] = None if t is None else (t[ADDRESS[1]].to_numpy(), t.drop_columns([ADDRESS[1]]))
            return held[key]

        for b in it:
            n = b.num_columns - 2
            files, rows = b.column(n).to_numpy(), b.column(n + 1).to_numpy()
            keys = np.stack([files, rows >> CHUNK_BITS])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if len(rows) else []
            for a, z in zip(starts, [*starts[1:], len(rows)], strict=True):
                if (found := piece((int(keys[0, a]), int(keys[1, a])))) is None:
                    continue
                known, t = found
                at = np.minimum(np.searchsorted(known, rows[a:z]), len(known) - 1)
                hit = np.flatnonzero(known[at] == rows[a:z])
                if len(hit):
                    mine = b.slice(a, z - a).take(pa.array(hit))
                    more = t.take(pa.array(at[hit])).combine_chunks()
                    columns = [mine.column(k) for k in range(n)] + [_whole(more[f.name]) for f in values]
                    met = pa.RecordBatch.from_arrays(columns, names=schema.names)
                    yield make[1](met) if make else met

    return docs.mapInArrow(look_up, make[0] if make else schema)


def _whole(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges(u, v), u <> v.

    Large-star and small-star rounds: each node's neighbours hang below the least of them. A minimum per node is
    aggregated before the shuffle and joined back, so that no hub's neighbours meet in one task's memory.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        return r[0], r[1]

    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    state = mark(cur)
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = minima(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = minima(large)
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), "edges")
        old, cur = cur, new
        release(old)
        if (now := mark(cur)) == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
