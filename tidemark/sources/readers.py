"""Readers of uploads: CSV, JSON lines and JSON, plain or gzipped, as one shape of raw records.

A raw record is (rec, v, file_ord, row_ord, parse_error): the record as a JSON object in text and parsed, the file's place in the
list, and an id that is ascending within a file, so that "the first one wins" has a meaning.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import RAW_SCHEMA

FORMATS = {".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json"}
#: Names under which an object may hold its list of records (fixed values).
WRAPPERS = ("posts", "data", "records", "items")


class UnsupportedFormatError(ValueError):
    pass


def detect_format(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2].lower().removesuffix(".gz")
    suffix = "." + name.rpartition(".")[2] if "." in name else ""
    if suffix not in FORMATS:
        raise UnsupportedFormatError(f"{path}: expected one of {', '.join(FORMATS)}, optionally with .gz")
    return FORMATS[suffix]


def natural_key(path: str) -> list:
    return [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", path.rpartition("/")[2])]


def expand_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Folders become their supported files in natural order; files stay in the order given."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        if fs.getFileStatus(p).isDirectory():
            names = [str(s.getPath().toString()) for s in fs.listStatus(p) if s.isFile()]
            out += sorted((n for n in names if any(n.lower().removesuffix(".gz").endswith(x) for x in FORMATS)), key=natural_key)
        else:
            detect_format(path)
            out.append(path)
    return out


def _parsed(lines: DataFrame) -> DataFrame:
    """Texts (rec) with their records, parsed once: null, and an error, where a text isn't a JSON object."""
    v = lines.select("rec", F.try_parse_json("rec").alias("v"))
    bad = F.col("v").isNull() | ~F.coalesce(F.trim("rec").startswith("{"), F.lit(False))
    return v.select("rec", "v", bad.alias("parse_error"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    record = F.struct(*[rows[f"`{c}`"] for c in rows.columns])
    return rows.select(F.to_json(record).alias("rec"), F.to_variant_object(record).alias("v"), F.lit(False).alias("parse_error"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(r"value rlike '\\S'")
    return _parsed(lines.select(F.col("value").alias("rec")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file is one task: an array, an object that holds one, or a single record."""
    v = F.trim(F.col("value"))
    lists = [F.get_json_object(v, f"$.{w}") for w in WRAPPERS]
    inner = F.coalesce(*[F.when(x.startswith("["), x) for x in lists])
    found = F.coalesce(F.from_json(F.when(v.startswith("["), v).otherwise(inner), "array<string>"), F.array(v))
    rows = spark.read.text(path, wholetext=True).select(F.explode(found).alias("rec"))
    return _parsed(rows)


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of all files, in the files' order."""
    by_format = {"csv": read_csv, "jsonl": read_jsonl, "json": read_json}
    parts = []
    for i, path in enumerate(expand_paths(spark, paths)):
        rows = by_format[detect_format(path)](spark, path)
        parts.append(rows.withColumn("file_ord", F.lit(i)).withColumn("row_ord", F.monotonically_increasing_id()))
    if not parts:
        raise UnsupportedFormatError("no supported files")
    return reduce(DataFrame.unionByName, parts)


def preview(raw: DataFrame, n: int = 10) -> DataFrame:
    if not 1 <= n <= 50:
        raise ValueError("a preview has 1 to 50 records")
    return raw.drop("v").orderBy("file_ord", "row_ord").limit(n)


def read_raw_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The raw profile's CSV files as strings, with their file's name and the time of loading."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("pathGlobFilter", "*.csv").schema(RAW_SCHEMA).csv(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("_source_file")).withColumn("_loaded_at", F.current_timestamp())


def sample_share(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """About a share of the rows, each drawn by itself; the same ones for the same input and seed."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n random rows, the same ones for the same input and seed."""
    return df.orderBy(F.rand(seed)).limit(n)
