"""Raw CSV input, processed parquet tables, CSV reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderflow.operators.reshape import day_name
from larderflow.schemas import CALENDAR, DAY_PREFIX, IDENTIFIERS, METRIC_HISTORY, PRICES, RAW_FILES, UNREADABLE, wide_sales
from larderflow.session import path_exists

# Columns a CSV file may have at most; a wider one raises.
MAX_COLUMNS = 100_000


def check_dataset_exists(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Which of the required raw files are present."""
    return {name: path_exists(spark, f"{folder.rstrip('/')}/{name}") for name in RAW_FILES.values()}


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, quotes and all as the CSV reader takes them; only its first line is read."""
    return spark.read.option("header", True).option("maxColumns", MAX_COLUMNS).csv(path).columns


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, or the file itself."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    listed = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    return sorted(str(f.getPath()) for f in listed if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._")


def read_csv(spark: SparkSession, path: str, known: T.StructType) -> DataFrame:
    """CSV with the declared types of known columns and text for the others, in the order of the first header.

    The files of a folder may have their columns in different orders; each is read by its own header, and a file with
    other columns than the first raises. A row with a cell that its column's type cannot hold has null there and its
    whole line in the column ``_unreadable``.
    """
    kinds = {f.name: f.dataType for f in known}
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in csv_files(spark, path) or [path]:
        groups.setdefault(tuple(csv_header(spark, file)), []).append(file)
    first = next(iter(groups))
    parts = []
    for header, files in groups.items():
        if set(header) != set(first):
            raise ValueError(f"columns of {files[0]} differ from those of the first file: {sorted(set(header) ^ set(first))}")
        fields = [T.StructField(c, kinds.get(c, T.StringType())) for c in header]
        reader = spark.read.schema(T.StructType([*fields, T.StructField(UNREADABLE, T.StringType())]))
        reader = reader.option("header", True).option("maxColumns", MAX_COLUMNS)
        parts.append(reader.option("columnNameOfCorruptRecord", UNREADABLE).csv(files))
    return reduce(DataFrame.unionByName, parts)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """Wide daily sales; every day column of the header is a number, as units may be fractions."""
    header = csv_header(spark, (csv_files(spark, path) or [path])[0])
    days = [T.StructField(c, T.DoubleType()) for c in header if c.startswith(DAY_PREFIX)]
    return read_csv(spark, path, T.StructType([*wide_sales(0).fields, *days]))


def read_sales_long(spark: SparkSession, path: str) -> DataFrame:
    """Long sales straight from the text lines of a wide CSV without quoted commas.

    One split and one ``posexplode`` per line replace thousands of typed columns. A cell that is neither empty nor a
    number has null sales and its text in ``_unreadable``. A line with more or fewer cells than the header (a quoted comma, a torn
    line) is one row of nulls with the whole line in ``_unreadable``.
    """
    header = csv_header(spark, path)
    days = [i for i, c in enumerate(header) if c.startswith(DAY_PREFIX)]
    if not days or days != list(range(days[0], len(header))):
        raise ValueError("day columns must be the last columns of the file")
    ids = [c for c in IDENTIFIERS if c in header]
    first_line = spark.read.text(path).first()[0]
    if first_line.replace('"', "").split(",") != header:
        raise ValueError("the header has quoted commas; use read_sales")
    lines = spark.read.text(path).where(F.col("value") != first_line).select("value", F.split("value", ",", -1).alias("_cells"))
    fits = F.size("_cells") == len(header)
    parts = lines.select(
        *[F.when(fits, F.get("_cells", F.lit(header.index(c)))).alias(c) for c in ids],
        F.when(fits, F.slice("_cells", days[0] + 1, len(days))).otherwise(F.array("value")).alias("_days"),
        fits.alias("_fits"),
    )
    exploded = parts.select(*ids, "_fits", F.posexplode("_days").alias("_pos", "_cell"))
    names = [header[i] for i in days]
    number = F.when(F.col("_fits"), F.expr("try_cast(_cell as double)"))
    unreadable = F.when(number.isNull() & (F.trim("_cell") != ""), F.col("_cell"))
    day = F.when(F.col("_fits"), day_name(names, F.col("_pos")))
    return exploded.select(*ids, day.alias("d"), number.alias("sales"), unreadable.alias(UNREADABLE))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CALENDAR)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Weekly prices; NaN cells become null."""
    return nan_to_null(read_csv(spark, path, PRICES))


def read_raw(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sales, calendar and prices of a raw folder; missing files are named together."""
    missing = [name for name, there in check_dataset_exists(spark, folder).items() if not there]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    base = folder.rstrip("/")
    return (
        read_sales(spark, f"{base}/{RAW_FILES['sales']}"),
        read_calendar(spark, f"{base}/{RAW_FILES['calendar']}"),
        read_prices(spark, f"{base}/{RAW_FILES['prices']}"),
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: aggregates skip null but not NaN."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One parquet dataset partitioned by ``split``; rows of a series lie together in date order."""
    order = [c for c in ("store_id", "item_id", "date") if c in df.columns]
    df.sortWithinPartitions("split", *order).write.mode(mode).partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows; each reads only its own partition folder."""
    whole = spark.read.parquet(path)
    return tuple(whole.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small result table as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def append_history(record: DataFrame, path: str) -> None:
    """Append metric records; nothing is written for an empty table."""
    if not record.isEmpty():
        record.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The metric history, empty before the first append."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], METRIC_HISTORY)
    return spark.read.schema(METRIC_HISTORY).parquet(path).select(*METRIC_HISTORY.names)


def append_once(record: DataFrame, path: str, source: str, number: int) -> None:
    """Append records under a transaction key: (source, number) is a folder of its own, so the same batch again replaces itself."""
    record.write.mode("overwrite").parquet(f"{path}/source={source}/batch={number}")
