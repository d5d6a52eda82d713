"""Readers and writers of the tables that steps exchange."""

from __future__ import annotations

import hashlib
import json
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lexicon import SCHEMA as LEXICON

SHARDS = "tag string, artist string, title string, year int, lyrics string"
SUMMARY = "word string, emerged double, peak_year int, peak_pct double, pct_now double, now_vs_peak double, rise_x double, total_entity_years int, log_ratio double, in_dictionary boolean, category string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the context's checkpoint folder; where both are unset, a
    temporary one if everything runs in this process, and an error on a cluster."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='wordtide-')}")
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def read_shards(spark: SparkSession, glob: str, schema: str = SHARDS) -> DataFrame:
    return spark.read.schema(schema).parquet(glob)


def with_provenance(df: DataFrame, shard: str = r"train-(\d+)-", per_shard: int = 1_000_000, whole: int | None = None) -> DataFrame:
    """Adds record: shard number (from the file's name) x per_shard + row in the file; stable over rebuilds.

    whole: the number of a table that is one shard, in however many files; rows are then counted on from file to file, by their paths. df is
    the table as it is read, with all its rows; a pass over its files counts theirs, and a row a file is sent to all tasks."""
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if whole is None:
        number = F.regexp_extract(path, shard, 1)
        return df.select("*", (F.nullif(number, F.lit("")).cast("long") * per_shard + row).alias("record"))
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    files = df.groupBy(plain.alias("_file")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("_file", plain).join(F.broadcast(files.select("_file", before.alias("_before"))), "_file")
    return out.select(*df.columns, (F.lit(whole * per_shard) + F.col("_before") + row).alias("record"))


def try_read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet table that may not be there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(schema).parquet(path)


def or_nulls(df: DataFrame, other: DataFrame | None, on: str, schema: str) -> DataFrame:
    """Left join of an optional table; its columns are null without it."""
    if other is not None:
        return df.join(other, on, "left")
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields if f.name != on])


def read_csv(spark: SparkSession, path: str, schema: str = SUMMARY) -> DataFrame:
    """Words such as nan and null are words: only an empty, unquoted field is null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue='""', nanValue="\x00")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEXICON).json(path, multiLine=True)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: lines of a dictionary, stripped and in lower case."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", compression)
    (w.partitionBy(*by) if by else w).parquet(path)


def _laid_name(path: str) -> str:
    return "wordtide_" + hashlib.md5(path.encode()).hexdigest()  # noqa: S324  a name, not a secret


def write_laid(df: DataFrame, path: str, by: list[str], on: str, buckets: int, compression: str = "zstd") -> DataFrame:
    """Write a table with a layout and open it: folders by the columns `by`, and in each folder a file for each of `buckets` buckets of
    `on`. Tables with equal buckets join and group by `on` without an exchange, and filters on `by` read only their folders. The layout lies in
    the files' schema, so that open_laid() knows it in any session."""
    spark, name = df.sparkSession, _laid_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = df.withMetadata(on, {"by": by, "buckets": buckets}).repartition(buckets, on)  # a task writes one bucket of each folder
    w = rows.write.mode("overwrite").option("compression", compression).option("path", path).format("parquet")
    (w.partitionBy(*by) if by else w).bucketBy(buckets, on).sortBy(on).saveAsTable(name)
    return open_laid(spark, path, on)


def open_laid(spark: SparkSession, path: str, on: str) -> DataFrame:
    """A table of write_laid(), by its path; it is named in the session's catalog on first use."""
    name = _laid_name(path)
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema
        layout = schema[on].metadata
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in layout['by'])}) " if layout["by"] else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by}CLUSTERED BY (`{on}`) SORTED BY (`{on}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
        if layout["by"]:
            spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def write_top_csv(df: DataFrame, path: str, order: list, n: int = 300) -> None:
    """The first n rows by an order that has no ties."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").csv(path, header=True)


def not_finite(c: Column, kind: T.DataType) -> Column | None:
    """Whether a NaN or an infinity lies anywhere in a value of that type; None where its type can't hold one."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [not_finite(c[f.name], f.dataType) for f in kind.fields]
        return reduce(Column.__or__, found) if (found := [x for x in parts if x is not None]) else None
    if isinstance(kind, T.ArrayType):
        return None if not_finite(c, kind.elementType) is None else F.coalesce(F.exists(c, lambda x: not_finite(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        sides = [not_finite(side(c), T.ArrayType(t)) for side, t in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))]
        return reduce(Column.__or__, found) if (found := [x for x in sides if x is not None]) else None
    return None


def as_json(c: Column, kind: T.DataType) -> Column:
    """Compact JSON with nulls written out. Raises where a double is NaN or infinite, at any depth, which JSON can't say."""
    bad, value = not_finite(c, kind), F.to_json(c, {"ignoreNullFields": "false"})
    return value if bad is None else F.when(bad, F.raise_error(F.lit("NaN or infinity can't be exported as JSON"))).otherwise(value)


def json_rows(df: DataFrame) -> DataFrame:
    """value: each row as JSON."""
    return df.select(as_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema).alias("value"))


def document(**sections: DataFrame) -> DataFrame:
    """value: one JSON object with an array of rows a section, in the order of their columns. Sections are as large as a page shows."""
    parts = []
    for i, (name, df) in enumerate(sections.items()):
        rows = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        text = as_json(F.col("rows"), T.ArrayType(df.schema))
        parts.append(df.agg(rows.alias("rows")).select(F.lit(i).alias("i"), F.concat(F.lit(json.dumps(name) + ":"), text).alias("part")))
    every = reduce(DataFrame.unionByName, parts)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x.part), ",")
    return every.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def write_document(path: str, **sections: DataFrame) -> None:
    document(**sections).coalesce(1).write.mode("overwrite").text(path)
