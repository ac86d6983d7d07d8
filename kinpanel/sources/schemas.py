"""Files of one table whose column types differ from year to year: footers are read on the executors, types are brought together."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = ["tinyint", "smallint", "int", "bigint"]
#: Where Spark keeps a table's types in files it has written.
_SPARK_TYPES = b"org.apache.spark.sql.parquet.row.metadata"
#: What other writers' types are read as, where the names differ.
_ARROW_TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "halffloat": "float", "float": "float", "double": "double", "date32[day]": "date",
    "string": "string", "large_string": "string", "string_view": "string",
    "binary": "binary", "large_binary": "binary", "binary_view": "binary",
}


def file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path`` and ``length`` of every file below a file, folder or glob; names that start with ``_`` or ``.`` do not count."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length")


def file_schemas(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, schema, error`` of every file: the schema as DDL text from the file's footer, read by the executors.

    ``error`` says why a footer could not be read; ``unreachable`` begins it where only Spark's own readers open the store.
    """
    return file_list(spark, path).select("path").mapInArrow(_footers, "path string, schema string, error string")


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        found = [_footer(p) for p in paths]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["path", "schema", "error"])


def _footer(path: str) -> tuple[str | None, str | None]:
    from pyarrow import fs, parquet

    try:
        local = re.match(r"file:/+", path)
        store, place = (fs.LocalFileSystem(), "/" + path[local.end() :]) if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
    except Exception as e:  # noqa: BLE001  every store has its own errors; they are told, not swallowed
        return None, f"unreachable: {e}"
    try:
        schema = parquet.read_schema(place, filesystem=store)
        return _ddl(schema), None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"[:500]


def _ddl(schema: pa.Schema) -> str:
    own = (schema.metadata or {}).get(_SPARK_TYPES)
    if own:
        fields = [(f.name, f.dataType.simpleString()) for f in T.StructType.fromJson(json.loads(own)).fields]
    else:
        fields = [(f.name, _spark_type(f.type)) for f in schema]
    return ", ".join(f"{_quoted(n)} {t}" for n, t in fields)


def _spark_type(t: pa.DataType) -> str:
    if pa.types.is_dictionary(t):
        return _spark_type(t.value_type)
    if pa.types.is_decimal(t):
        return f"decimal({t.precision},{t.scale})"
    if pa.types.is_timestamp(t):
        return "timestamp" if t.tz else "timestamp_ntz"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"array<{_spark_type(t.value_type)}>"
    if pa.types.is_struct(t):
        return f"struct<{', '.join(f'{_quoted(f.name)}: {_spark_type(f.type)}' for f in t)}>"
    if pa.types.is_map(t):
        return f"map<{_spark_type(t.key_type)}, {_spark_type(t.item_type)}>"
    if str(t) not in _ARROW_TYPES:
        raise TypeError(f"no type for {t}")
    return _ARROW_TYPES[str(t)]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def widest(types: set[str]) -> str | None:
    """The type that a scan can read files of all these types as; None where there is none."""
    if len(types) == 1:
        return next(iter(types))
    if types <= set(WHOLE):
        return max(types, key=WHOLE.index)
    if types <= {"tinyint", "smallint", "int", "float", "double"}:
        return "double"
    return None


def common_types(types: set[str]) -> dict[str, str]:
    """For each type the one it is read as: as few different ones as scans allow."""
    numbers = {t for t in types if t in WHOLE or t in ("float", "double")}
    whole = numbers & set(WHOLE)
    classes = [numbers] if numbers and widest(numbers) else [whole, numbers - whole]
    out = {t: widest(c) for c in classes for t in c}
    return {t: out.get(t, t) for t in types}


def type_groups(spark: SparkSession, path: str | list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Files that one scan can read together, with the schema to read them by.

    One job reads the footers and gathers the files of equal schemas. Numbers of different widths are read as the widest. Only
    columns whose types have nothing wider in common part the files, and only by what these columns are read as. A schema has all
    columns of the table, but for those that part the files and that its own files lack. Raises when a footer cannot be read.
    """
    found = file_schemas(spark, path).groupBy("schema").agg(F.sort_array(F.collect_list("path")).alias("files"), F.first("error", ignorenulls=True).alias("error")).collect()
    bad = next((r for r in found if r["error"]), None)
    if bad is not None and bad["error"].startswith("unreachable"):
        merged = _by_merging(spark, sorted(f for r in found for f in r["files"]))
        return _grouped(spark, [({f.name: f.dataType.simpleString() for f in schema}, files) for schema, files in merged])
    if bad is not None:
        raise ValueError(f"cannot read {bad['files'][0]} ({len(bad['files'])} such files): {bad['error']}")
    return _grouped(spark, [(_fields(spark, r["schema"]), r["files"]) for r in found])


def _grouped(spark: SparkSession, schemas: list[tuple[dict[str, str], list[str]]]) -> list[tuple[T.StructType, list[str]]]:
    schemas = sorted(schemas, key=lambda x: x[1][0])
    types: dict[str, set[str]] = {}
    for fields, _ in schemas:
        for name, kind in fields.items():
            types.setdefault(name, set()).add(kind)
    common = {name: common_types(kinds) for name, kinds in types.items()}
    apart = [name for name, kinds in common.items() if len(set(kinds.values())) > 1]
    groups: dict[tuple, list[str]] = {}
    for fields, files in schemas:
        groups.setdefault(tuple(common[c].get(fields.get(c)) for c in apart), []).extend(files)
    out = []
    for kinds, files in groups.items():
        own = {name: next(iter(kinds.values())) for name, kinds in common.items()} | dict(zip(apart, kinds, strict=True))
        ddl = ", ".join(f"{_quoted(n)} {t}" for n, t in own.items() if t)
        out.append((spark.createDataFrame([], ddl).schema, sorted(files)))
    return out


def _fields(spark: SparkSession, ddl: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], ddl).schema.fields}


def _by_merging(spark: SparkSession, files: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Groups in stores that only Spark opens: Spark merges the footers of all files, or else of either half."""
    try:
        return [(spark.read.option("mergeSchema", True).parquet(*files).schema, files)]
    except (Py4JJavaError, PySparkException) as e:
        if "CANNOT_MERGE" not in str(e) or len(files) == 1:
            raise
    middle = len(files) // 2
    return _by_merging(spark, files[:middle]) + _by_merging(spark, files[middle:])


def read_each(spark: SparkSession, path: str | list[str], base: str | None = None) -> list[DataFrame]:
    """The files as one table or, where a column's types have nothing in common, as one table for each of them.

    Merging the footers, a job of Spark's own, comes first; only where it fails are types compared. ``base`` is the folder below
    which folders name partitions.
    """
    paths = [path] if isinstance(path, str) else list(path)
    try:
        return [spark.read.option("mergeSchema", True).parquet(*paths)]
    except (Py4JJavaError, PySparkException) as e:
        if "CANNOT_MERGE" not in str(e):
            raise
    reader = spark.read if base is None else spark.read.option("basePath", base)
    return [reader.schema(schema).parquet(*files) for schema, files in type_groups(spark, paths)]


def together(frames: list[DataFrame]) -> DataFrame:
    """Rows of all tables; a column has its widest type, or is text where the types have nothing in common."""
    types: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            types.setdefault(name, set()).add(kind)
    wanted = {name: widest(kinds) or "string" for name, kinds in types.items()}
    same = [df.select(*[F.col(_quoted(c)).cast(wanted[c]).alias(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def read_reconciled(spark: SparkSession, path: str | list[str], shape: Callable[[DataFrame], DataFrame] | None = None, base: str | None = None) -> DataFrame:
    """A table from files that may lack columns and whose types may differ. ``shape`` is applied to each scan before they are brought
    together, so it may use what only a scan has, as the file's name."""
    frames = read_each(spark, path, base)
    shaped = [shape(df) for df in frames] if shape else frames
    return shaped[0] if len(shaped) == 1 else together(shaped)
