"""Readers of releases, annotations, predictions, corrections and nested pages."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..operators import kb

#: Positions of the fields read of each release file.
RRF_FIELDS = {
    "MRCONSO": {"cui": 0, "lat": 1, "ts": 2, "sab": 11, "tty": 12, "code": 13, "term": 14},
    "MRSTY": {"cui": 0, "sem_code": 1, "tree_code": 2, "sem_name": 3},
    "MRDEF": {"cui": 0, "definition": 5},
}


def rrf(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A release file, extracted or gzipped, by field names; UTF-8 throughout."""
    return kb.rrf_fields(spark.read.text(path), RRF_FIELDS[kind])


class ZippedLines(DataSource):
    """spark.read.format("zipped_lines").option("path", zip).option("member", name): lines of a member of a zip file.

    A zip member can't be split, so each member is one partition; option members (comma-separated) reads several.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        members = self.options.get("members") or self.options["member"]
        return _ZipReader(self.options["path"], members.split(","))


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, members: list[str]):
        self.path, self.members = path, members

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(m) for m in self.members]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        import io

        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(partition.value) as member:
            for line in io.TextIOWrapper(member, "utf-8", newline="\n"):
                yield (line.rstrip("\r\n"),)


def zipped_rrf(spark: SparkSession, path: str, member: str, kind: str) -> DataFrame:
    spark.dataSource.register(ZippedLines)
    return kb.rrf_fields(spark.read.format("zipped_lines").option("path", path).option("member", member).load(), RRF_FIELDS[kind])


def decode_escapes(term: Column) -> Column:
    """Text of older extractions in which bytes stand as \\xNN; as a column."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return x.encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1").decode("utf-8") if x and "\\" in x else x
            except (UnicodeDecodeError, UnicodeEncodeError):
                return x

        return s.map(one)

    return decode(term)




def tsv(spark: SparkSession, path: str, schema: str, quoting: bool = True, null: str | None = None) -> DataFrame:
    """A tab-separated file with a header; ids stay strings by the schema."""
    r = spark.read.schema(schema).option("sep", "\t").option("header", True)
    if not quoting:
        r = r.option("quote", "")
    if null is not None:
        r = r.option("nullValue", null)
    return r.csv(path)


def semantic_groups(spark: SparkSession, path: str) -> DataFrame:
    """The headerless |-separated list of groups."""
    return spark.read.schema("category string, grp string, sem_code string, sem_name string").option("sep", "|").csv(path)


def corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORRECTION).option("header", True).csv(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents as JSON (an array or a document a line) or Parquet, with the schema given."""
    if path.endswith(".json"):
        return spark.read.schema(schemas.PAGE).option("multiLine", True).json(path)
    if path.endswith(".jsonl"):
        return spark.read.schema(schemas.PAGE).json(path)
    return spark.read.parquet(path)


def runs(spark: SparkSession, pattern: str, schema: str = schemas.PREDICTION, dataset: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """All result files of a glob with their path and the dataset in it."""
    d = tsv(spark, pattern, schema).withColumn("path", F.input_file_name())
    return d.withColumn("dataset", F.regexp_extract("path", dataset, 1))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


def strict_entities(entities: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Entities of a single fragment, of listed labels."""
    d = entities.where(F.size("fragments") == 1)
    return d.where(F.col("entity_type").isin(*labels)) if labels else d
