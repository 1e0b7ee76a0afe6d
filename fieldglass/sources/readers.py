"""Readers with stable row ids, typed binding and strict checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.cells import invalid_number, missing, numeric, parse_integer, trim_ws
from .inference import infer_kinds

#: Column that holds the dense, 0-based source order.
ROW_ID = "row_id"


def suffix_of(path: str) -> str:
    """'csv' or 'parquet', in any case; anything else is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "parquet"):
        raise ValueError(f"cannot read {path!r}: a .csv or .parquet file is needed")
    return kind


def check_limit(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise ValueError("a row limit must be at least 1")


def read_table(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The table with :data:`ROW_ID`; the first ``limit`` rows in source order.

    CSV columns stay text; ragged rows are an error when read.  Parquet keeps
    its types, and without a use of the ids the scan stays pruned.  With a
    limit, only the first files that hold so many rows are read.
    """
    check_limit(limit)
    if suffix_of(path) == "csv":
        raw = spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
        out = number_rows(raw)
    else:
        out = number_parquet_rows(spark.read.parquet(path) if limit is None else _first_files(spark, path, limit))
    return out if limit is None else out.where(F.col(ROW_ID) < limit)


def _first_files(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The table, of as many files in order of path as hold ``limit`` rows; rows are counted from the footers."""
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles())
    if len(files) < 2:
        return whole
    read = spark.read.schema(whole.schema).option("basePath", path)
    rows = 0
    for i, file in enumerate(files):
        rows += read.parquet(file).count()
        if rows >= limit:
            return read.parquet(*files[: i + 1])
    return whole


def number_parquet_rows(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Dense ids in order of file path and row: the row's index in its file plus the rows of the files before.

    One row for each file is counted, ranked and sent to the tasks; nothing
    else is shuffled, so the rows of a large file stay in as many tasks.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = at.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = at.join(F.broadcast(files.select("_file", before.alias("_before"))), "_file")
    return joined.select((F.col("_before") + F.col("_index")).cast("long").alias(name), *[F.col(c) for c in df.columns])


def aggregate_with_ids(df: DataFrame, name: str, **measures: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """One row: ``measures``, and as ``ids`` the number of distinct ids in column ``name``, exactly.

    A measure is an aggregate over the rows and the function that joins parts
    of it.  An id is a bit of a 64-bit word; dense ids fill the words, so a task
    sends one row for 64 of them.  Null is no id; negative ids count too.
    """
    id_ = F.col(name).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), id_.bitwiseAND(F.lit(63)).cast("int"))
    words = df.groupBy(F.shiftright(id_, 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"), *[a.alias(f"_{k}") for k, (a, _) in measures.items()])
    return words.agg(*[join(f"_{k}").alias(k) for k, (_, join) in measures.items()], F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).cast("long").alias("ids"))


def number_rows(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Dense ids in partition order, for sources without row positions.

    Rows are counted by partition (one number each); ids are the offsets plus
    the place in the partition.  The source must read the same way twice, as
    files do.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = df.select(F.spark_partition_id().alias("_part"), local.alias("_place"), *df.columns)
    counts = dict(at.groupBy("_part").count().collect())
    offset, offsets = 0, [0] * (max(counts, default=-1) + 1)
    for p in range(len(offsets)):
        offsets[p], offset = offset, offset + counts.get(p, 0)
    start = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_part") + 1) if offsets else F.lit(0)
    return at.select((start + F.col("_place")).cast("long").alias(name), *df.columns)


def table_schema(spark: SparkSession, path: str, limit: int | None = None) -> list[tuple[str, str]]:
    """(column, kind): from the footer for Parquet, by inference over the rows for CSV."""
    if suffix_of(path) == "parquet":
        return [(f.name, logical_kind(f.dataType)) for f in spark.read.parquet(path).schema]
    rows = read_table(spark, path, limit).drop(ROW_ID)
    return list(infer_kinds(rows).items())


def logical_kind(kind: T.DataType) -> str:
    """Integer, Float, String, Empty, Boolean, Timestamp or Unsupported."""
    from ..operators.diff import kind_name

    return kind_name(kind)


@dataclass
class Loaded:
    """A bound table: the rows with typed roles, and the extents of its axes."""

    rows: DataFrame
    x_range: tuple
    y_range: tuple
    count: int
    labels: tuple[str, ...] = ()


def _need(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"column {c!r} does not exist")


def load_scatter(spark: SparkSession, path: str, x: str, y: str, limit: int | None = None) -> Loaded:
    """Bind two numeric columns as ``px`` and ``py``; any blank or malformed cell fails the load, and names its column.

    One aggregate checks and measures both axes.
    """
    df = read_table(spark, path, limit)
    return bind_scatter(df, x, y)


def bind_scatter(df: DataFrame, x: str, y: str) -> Loaded:
    _need(df, x, y)
    kinds = {f.name: f.dataType for f in df.schema}
    px, py = numeric(F.col(x), kinds[x]), numeric(F.col(y), kinds[y])
    bad = [F.count_if(missing(F.col(c), kinds[c]) | invalid_number(F.col(c), kinds[c])) for c in (x, y)]
    n, bx, by, x0, x1, y0, y1 = df.agg(F.count(F.lit(1)), *bad, F.min(px), F.max(px), F.min(py), F.max(py)).first()
    if not n:
        raise ValueError("the table has no rows")
    for c, b in ((x, bx), (y, by)):
        if b:
            raise ValueError(f"column {c!r} has {b} cells that are not finite numbers")
    return Loaded(df.withColumn("px", px).withColumn("py", py), (x0, x1), (y0, y1), n)


def load_timeline(spark: SparkSession, path: str, time: str, lane: str, limit: int | None = None) -> Loaded:
    """Bind a time of unsigned integers as ``ts`` and a lane as ``lane`` (ids in first-seen order) with ``value`` 1."""
    return bind_timeline(read_table(spark, path, limit), time, lane)


def bind_timeline(df: DataFrame, time: str, lane: str, row_id: str = ROW_ID) -> Loaded:
    from .lanes import lane_dictionary, with_lane

    _need(df, time, lane)
    kind = df.schema[time].dataType
    ts = unsigned(F.col(time), kind)
    blank = missing(F.col(lane), df.schema[lane].dataType)
    n, bad, blanks, t0, t1 = df.agg(F.count(F.lit(1)), F.count_if(ts.isNull()), F.count_if(blank), F.min(ts), F.max(ts)).first()
    if not n:
        raise ValueError("the table has no rows")
    if bad:
        raise ValueError(f"column {time!r} has {bad} cells that are not unsigned integers")
    if blanks:
        raise ValueError(f"column {lane!r} has {blanks} blank lanes")
    lanes = lane_dictionary(df, lane, row_id)
    labels = tuple(r.label for r in lanes.orderBy("lane").collect())
    rows = with_lane(df.withColumn("ts", ts).withColumn("value", F.lit(1.0).cast("float")), lanes, lane)
    return Loaded(rows, (int(t0), int(t1)), (0, len(labels)), n, labels)


def unsigned(c: Column, kind: T.DataType) -> Column:
    """A non-negative integer as long, or as decimal(20,0) from text; null when it is neither."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.when(c >= 0, c.cast("long"))
    if isinstance(kind, T.DecimalType):
        return F.when(c >= 0, c.cast("decimal(20,0)"))
    v = parse_integer(c.cast("string"))
    return F.when((v >= 0) & ~trim_ws(c.cast("string")).startswith("-"), v)


def check_flat_schema(schema: T.StructType, required: tuple[str, ...] = ()) -> None:
    """Names are unique and not blank, kinds are flat (null, integer, float, text), and the required columns exist."""
    names = [f.name for f in schema]
    if any(not n.strip() for n in names):
        raise ValueError("a column name is blank")
    if len(set(names)) < len(names):
        raise ValueError("column names are not unique")
    for f in schema:
        if not isinstance(f.dataType, (T.NullType, T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
            raise ValueError(f"column {f.name!r} of type {f.dataType.simpleString()} is not flat")
    for c in required:
        if c not in names:
            raise ValueError(f"column {c!r} does not exist")


def from_frame(spark: SparkSession, frame: object, required: tuple[str, ...] = ()) -> DataFrame:
    """A Spark, pandas, Arrow or Polars frame as a checked DataFrame; Polars goes through Arrow, lazy frames are collected there."""
    if isinstance(frame, DataFrame) or hasattr(frame, "sparkSession"):
        df = frame
    else:
        if hasattr(frame, "collect") and hasattr(frame, "lazy"):
            frame = frame.collect()
        if hasattr(frame, "to_arrow"):
            frame = frame.to_arrow()
        df = spark.createDataFrame(frame)
    check_flat_schema(df.schema, required)
    return df


def source_text(df: DataFrame) -> DataFrame:
    """All columns as display text, null as the empty text; nested types are an error."""
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(f"column {f.name!r} of type {f.dataType.simpleString()} has no text form")
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def cell_at(df: DataFrame, row_id: int, column: str, name: str = ROW_ID) -> object:
    """One cell; an unknown row or column is an error."""
    _need(df, column)
    row = df.where(F.col(name) == row_id).select(column).first()
    if row is None:
        raise KeyError(f"row {row_id} does not exist")
    return row[0]
