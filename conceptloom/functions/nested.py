"""Nested values as dotted paths, and back.

A value becomes an array of (path, value): parts of a path are names of fields, numbers of elements and keys of maps,
joined by dots; dots, hashes and percent signs in names and keys are escaped. A struct, array or map has a line of its own
that ends in #, with its keys or size, so that nulls, empty values and missing ones stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType

LINES = "array<struct<path:string,value:string>>"


def escaped(name: Column) -> Column:
    return F.replace(F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E")), F.lit("#"), F.lit("%23"))


def _line(path: Column, value: Column) -> Column:
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def _below(prefix: Column, part: Column) -> Column:
    return F.when(prefix == "", part).otherwise(F.concat(prefix, F.lit("."), part))


def lines(value: Column, kind: DataType, prefix: Column) -> Column:
    """The lines of a value of a type below a path; none for a null."""
    none = F.array().cast(LINES)
    if isinstance(kind, StructType):
        own = _line(F.concat(prefix, F.lit("#")), F.lit(len(kind.fields)))
        parts = [lines(value.getField(f.name), f.dataType, _below(prefix, escaped(F.lit(f.name)))) for f in kind.fields]
        return F.when(value.isNull(), none).otherwise(F.concat(own, *parts))
    if isinstance(kind, ArrayType):
        own = _line(F.concat(prefix, F.lit("#")), F.size(value))
        each = F.transform(value, lambda x, i: lines(x, kind.elementType, _below(prefix, i.cast("string"))))
        return F.when(value.isNull(), none).otherwise(F.concat(own, F.flatten(each)))
    if isinstance(kind, MapType):
        keys = F.transform(F.map_keys(value), lambda k: k.cast("string"))
        own = _line(F.concat(prefix, F.lit("#")), F.to_json(keys))
        each = F.transform(F.map_entries(value), lambda e: lines(e["value"], kind.valueType, _below(prefix, escaped(e["key"].cast("string")))))
        return F.when(value.isNull(), none).otherwise(F.concat(own, F.flatten(each)))
    shown = F.base64(value) if isinstance(kind, BinaryType) else value.cast("string")
    return F.when(value.isNull(), none).otherwise(_line(prefix, shown))


def rebuilt(at: Column, kind: DataType, prefix: Column) -> Column:
    """The value of a type that a map from paths to texts holds below a path."""
    own = F.element_at(at, F.concat(prefix, F.lit("#")))
    null = F.lit(None).cast(kind)
    if isinstance(kind, StructType):
        fields = [rebuilt(at, f.dataType, _below(prefix, escaped(F.lit(f.name)))).alias(f.name) for f in kind.fields]
        return F.when(own.isNull(), null).otherwise(F.struct(*fields))
    if isinstance(kind, ArrayType):
        places = F.filter(F.sequence(F.lit(-1), own.cast("int") - 1), lambda i: i >= 0)
        each = F.transform(places, lambda i: rebuilt(at, kind.elementType, _below(prefix, i.cast("string"))))
        return F.when(own.isNull(), null).otherwise(each)
    if isinstance(kind, MapType):
        each = F.transform(F.from_json(own, "array<string>"), lambda k: F.struct(k.cast(kind.keyType), rebuilt(at, kind.valueType, _below(prefix, escaped(k)))))
        return F.when(own.isNull(), null).otherwise(F.map_from_entries(each))
    text = F.element_at(at, prefix)
    return F.unbase64(text) if isinstance(kind, BinaryType) else text.cast(kind)


def flattened(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, value): the lines of all other columns, a row each. keys tell rows apart; a row of nulls alone has none."""
    rest = [f for f in df.schema.fields if f.name not in keys]
    if not rest:
        raise ValueError("no column but keys")
    all_ = F.concat(*(lines(df[f"`{f.name}`"], f.dataType, escaped(F.lit(f.name))) for f in rest))
    return df.select(*keys, F.explode(all_).alias("x")).select(*keys, "x.path", "x.value")


def unflattened(long: DataFrame, keys: list[str], schema: StructType) -> DataFrame:
    """The rows of flattened() with the columns of schema: keys, then the rest as it was."""
    at = F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("__at")
    d = long.groupBy(*keys).agg(at)
    rest = [f for f in schema.fields if f.name not in keys]
    return d.select(*keys, *(rebuilt(F.col("__at"), f.dataType, escaped(F.lit(f.name))).alias(f.name) for f in rest))


def dotted(df: DataFrame) -> DataFrame:
    """Structs of fixed fields as columns with dotted names, at any depth; other columns as they are."""

    def walk(c: Column, kind: DataType, name: str) -> list[Column]:
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in walk(c.getField(f.name), f.dataType, f"{name}.{f.name}")]
        return [c.alias(name)]

    return df.select(*(x for f in df.schema.fields for x in walk(df[f"`{f.name}`"], f.dataType, f.name)))
