"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.session import shared_dir

#: What goes to Python at a time where a table is written on the way.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: Column) -> Column:
    """A text column as UTF-8 bytes; Arrow then hands it to Python without decoding."""
    return column.cast("string").cast("binary")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: no lineage, and it outlives executors."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_of(path: str) -> str:
    """The catalog's name for a bucketed table."""
    return path.rpartition("/")[2].replace("-", "_")


def by_bucket(df: DataFrame, name: str, column: str, then: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
    """Like cut(), but dealt to as many buckets as shuffles have partitions: joins on ``column`` move only the other side.

    ``then`` may work on the dealt rows by that column, without another shuffle.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    made = _table_of(path)
    with small_batches(spark):
        then(df.repartition(n, column)).write.bucketBy(n, column).option("path", path).saveAsTable(made, format="parquet")
    return spark.table(made)


def drop_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing reads them any more."""
    paths = {f.rpartition("/")[0] for frame in frames for f in frame.inputFiles()}
    paths = [p for p in paths if "/tidemark-" in p]
    for p in paths:
        spark.sql(f"DROP TABLE IF EXISTS {_table_of(p)}")
    drop_paths(spark, paths)


def over_batches(make: Callable[[dict], dict | Iterator[dict]], schema: pa.Schema) -> Callable:
    """mapInArrow function: ``make`` gets a batch's columns as lists and gives columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = make({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema
                )

    return run


def key_or(column: Column, instead: int = -(1 << 63)) -> Column:
    """A document's id as bigint, with null in front of all ids."""
    return F.coalesce(column.cast("bigint"), F.lit(instead))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile send Python BATCH_ROWS rows or BATCH_BYTES at a time; the session's settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def packed(df: DataFrame, without: Iterable[str] = ()) -> tuple[Column, Callable[[], list[Column]]]:
    """df's columns, but for those named (in any case), as a struct called ``row``, and what unpacks them: no name of a user clashes with ours."""
    left_out = {x.lower() for x in without}
    names = [c for c in df.columns if c.lower() not in left_out]
    row = F.struct(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)], F.lit(0).alias("none")).alias("row")
    return row, lambda: [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_arrow(df: DataFrame, inputs: list[Column], make: Callable[..., dict], fields: str) -> DataFrame:
    """Appends columns computed in Python from ``inputs``; only these cross over, all other columns stay in the JVM.

    ``make`` gets a list per input and returns the new columns by name.  A column of df that has a
    new column's name, in any case, is replaced.
    """
    new = T._parse_datatype_string(fields)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new]

    def run(*columns: pa.Array) -> pa.Array:
        made = make(*[c.to_pylist() for c in columns])
        out = pa.StructArray.from_arrays([pa.array(made[k], t) for k, t in kinds], names=[k for k, _ in kinds])
        pa.default_memory_pool().release_unused()  # workers are used again
        return out

    # not deterministic for Spark, so that no filter on a new column runs it twice
    called = F.arrow_udf(run, new).asNondeterministic()(*inputs)
    made, replaced = unused(df, "made"), {k.lower() for k in new.names}
    out = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in replaced], called.alias(made))
    return out.select(*[f"`{c}`" for c in out.columns[:-1]], *[F.col(made)[k].alias(k) for k in new.names])
