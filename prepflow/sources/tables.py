"""Reading tables by file type, writing results, and looking at a few rows."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prepflow.functions.columns import aggregate, col, nan_to_null, per_column_agg, scalar_columns

# fixed values
FORMATS = ("csv", "json", "parquet")
# The strings read as missing in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_FALSE = ("True", "TRUE", "true", "False", "FALSE", "false")
INTEGER = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """Read a table by its file extension; globs and directories named ``*.csv`` etc. work too."""
    kind = path.rstrip("/").rsplit("/", 1)[-1].lower().rsplit(".", 1)[-1]
    if kind not in FORMATS:
        raise ValueError(f"Unsupported format: .{kind}. Supported: {', '.join(FORMATS)}")
    try:
        if kind == "csv":
            return read_csv(spark, path, schema, multi_line)
        return read_json(spark, path, schema) if kind == "json" else read_parquet(spark, path, schema)
    except (PySparkException, Py4JError) as e:
        raise ValueError(f"Failed to parse file: {e}") from e


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The files as they are, so that filters on any column reach the scan; the operators read NaN as missing."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _open_quotes(spark: SparkSession, path: str) -> int:
    """Lines with an odd number of quotes: a quoted text goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).count()


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    multi_line: bool = False,
    lossy: bool = False,
) -> DataFrame:
    """Header row; every usual missing-value token becomes NULL.

    Without a schema all columns are read as text and typed by one aggregate scan (boolean,
    bigint, double, else string). With one, a scan makes sure that every cell fits its type, and
    cells that do not are an error; ``lossy`` saves that scan and makes them NULL.

    Quoted text may hold line breaks only with ``multi_line``, which gives up splitting files
    between tasks; without it a file that needs it is an error, never wrong rows.
    """
    if not multi_line:
        broken = _open_quotes(spark, path)
        if broken:
            raise ValueError(f"{broken} lines end within quotes: read with multi_line=True")
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line}
    raw = spark.read.options(**options, inferSchema=False).csv(path)
    text = raw.select(*[F.when(~col(n).isin(*NA_TOKENS), col(n)).alias(n) for n in raw.columns])
    if schema is not None:
        wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        typed = {f.name: col(f.name).try_cast(f.dataType) for f in wanted}
        if not lossy:
            lost = aggregate(text, [F.count(col(n)) - F.count(c) for n, c in typed.items()])
            bad = {n: k for n, k in zip(typed, lost) if k}
            if bad:
                raise ValueError(f"cells that do not fit the schema, by column: {bad}")
        return nan_to_null(text.select(*[c.alias(n) for n, c in typed.items()]))
    seen = per_column_agg(
        text,
        text.columns,
        {
            "present": lambda n: F.count(col(n)),
            "bools": lambda n: F.count(F.when(col(n).isin(*TRUE_FALSE), 1)),
            "ints": lambda n: F.count(
                F.when(F.trim(col(n)).rlike(INTEGER), F.trim(col(n)).try_cast("bigint"))
            ),
            "doubles": lambda n: F.count(
                F.when(F.trim(col(n)).rlike(DECIMAL), F.trim(col(n)).try_cast("double"))
            ),
        },
    )
    kinds = {}
    for r in seen.collect():
        kind = "string"
        if r["present"]:
            if r["bools"] == r["present"]:
                kind = "boolean"
            elif r["ints"] == r["present"]:
                kind = "bigint"
            elif r["doubles"] == r["present"]:
                kind = "double"
        kinds[r["column"]] = kind
    return text.select(
        *[
            col(n) if kinds[n] == "string" else F.trim(col(n)).try_cast(kinds[n]).alias(n)
            for n in text.columns
        ]
    )


def _array_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, files whose first character that is not blank opens an array): all files are looked at."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("v")
    )
    first = rows.where((F.col("v") != "")).groupBy("file", F.col("at").bitwiseAND(F.lit(-1 << 33)).alias("part"))
    heads = first.agg(F.min_by(F.substring("v", 1, 1), "at").alias("c")).groupBy("file").agg(F.min_by("c", "part").alias("c"))
    return tuple(heads.agg(F.count(F.lit(1)), F.count_if(F.col("c") == "[")).first())


def read_json(
    spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool | None = None
) -> DataFrame:
    """One record per line, or documents that each hold an array of records: such a file is one task.

    ``lines`` says which; without it all files are looked at, and they must agree. Text that is
    not JSON is an error.
    """
    if lines is None:
        files, arrays = _array_files(spark, path)
        if 0 < arrays < files:
            raise ValueError(f"{arrays} of {files} files hold arrays: read the two kinds apart")
        lines = not arrays
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.json(path, multiLine=not lines, mode="FAILFAST"))


CSV_OUT = {
    "header": True,
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, UTF-8, no row index; one part file per task."""
    df.write.mode(mode).options(**CSV_OUT).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def current_stage(
    raw: DataFrame, cleaned: DataFrame | None = None, engineered: DataFrame | None = None
) -> DataFrame:
    """The latest stage that exists."""
    return next(d for d in (engineered, cleaned, raw) if d is not None)


def preview_rows(df: DataFrame, order_by: Sequence[str], n: int = 50) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order: a top-k, never a full sort."""
    return df.orderBy(*[col(k) for k in order_by]).limit(n)


def row_hash(keys: Sequence[str], seed: str = "") -> Column:
    """A reproducible random order: md5 of the key columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[col(k).cast("string") for k in keys]))


def _hash_limit(rows: int, total: int) -> str | None:
    """An md5 prefix below which about 8x ``rows`` of ``total`` hashes fall; None keeps all."""
    share = (8 * rows + 200) / max(total, 1)
    if share >= 1:
        return None
    return format(int(share * (1 << 64)), "016x")


def sample_rows(
    df: DataFrame, keys: Sequence[str], k: int, n_rows: int | None = None, seed: str = ""
) -> DataFrame:
    """``k`` rows drawn without replacement, the same ones on every run: smallest key hashes first.

    A hash limit computed from the row count drops almost all rows before the top-k, so no
    task ever holds more than a small multiple of ``k``.
    """
    n_rows = df.count() if n_rows is None else n_rows
    hashed = df.withColumn("__h", row_hash(keys, seed))
    limit = _hash_limit(k, n_rows)
    if limit is not None:
        near = hashed.where(F.col("__h") < limit)
        if near.count() >= k:
            hashed = near
    return hashed.orderBy("__h", *[col(c) for c in keys]).limit(k).drop("__h")


def sample_values(
    df: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None, k: int = 5
) -> DataFrame:
    """Up to ``k`` non-null values of every column as text, reproducibly drawn."""
    names = list(names if names is not None else scalar_columns(df))
    present = {
        r["column"]: r["present"]
        for r in per_column_agg(df, names, {"present": lambda n: F.count(col(n))}).collect()
    }
    hashed = df.select(row_hash(keys).alias("__h"), *[col(n).cast("string").alias(n) for n in names])
    limits = {n: _hash_limit(k, present[n]) for n in names}
    near = None
    for n in names:
        test = col(n).isNotNull()
        if limits[n] is not None:
            test = test & (F.col("__h") < limits[n])
        near = test if near is None else near | test
    order = Window.partitionBy("column").orderBy("__h", "value")

    def ranked(rows: DataFrame) -> DataFrame:
        return (
            rows.unpivot(["__h"], [col(n) for n in names], "column", "value")
            .where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .drop("__h")
        )

    drawn = ranked(hashed.where(near))
    got = {r["column"]: r["count"] for r in drawn.groupBy("column").count().collect()}
    if any(got.get(n, 0) < min(k, present[n]) for n in names):
        drawn = ranked(hashed)
    return drawn
