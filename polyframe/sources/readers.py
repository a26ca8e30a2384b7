"""Reading files by format or by their ending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: File endings and the format that they stand for.
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".orc": "orc", ".txt": "text", ".xml": "xml"}


def format_of(path: str) -> str | None:
    """The format that a path's ending names; a compression ending is passed over."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for packed in (".gz", ".bz2", ".zst", ".snappy", ".lz4"):
        name = name.removesuffix(packed)
    return next((f for ending, f in FORMATS.items() if name.endswith(ending)), None)


def read(
    spark: SparkSession,
    path: str | Sequence[str],
    format: str | None = None,
    schema: str | StructType | None = None,
    filename: str | None = None,
    skip: int = 0,
    null_padding: bool | None = None,
    ignore_errors: bool | None = None,
    **options,
) -> DataFrame:
    """Rows of one or more paths.

    ``format`` defaults to what the first path's ending says. ``filename`` names a column for the
    file each row came from. Options are Spark's; None leaves one at its default. For CSV files
    further: ``skip`` leaves out so many leading lines of each file, ``null_padding`` fills short
    rows with nulls, ``ignore_errors`` drops rows that do not fit the schema. With these, files are
    read line by line, in splits as any text, so quoted line ends are not understood.
    """
    paths = [path] if isinstance(path, str) else list(path)
    kind = format or format_of(paths[0])
    if kind is None:
        raise ValueError(f"no format is given and {paths[0]} has no known ending")
    given = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if v is not None}
    if skip or null_padding or ignore_errors:
        if kind != "csv":
            raise ValueError("skip, null_padding and ignore_errors are for csv files")
        return _lines(spark, paths, schema, filename, skip, bool(null_padding), bool(ignore_errors), given)
    reader = spark.read.format(kind).options(**given)
    if schema is not None:
        reader = reader.schema(schema)
    frame = reader.load(paths)
    return frame.withColumn(filename, F.col("_metadata.file_path")) if filename else frame


def _lines(spark: SparkSession, paths: list[str], schema: str | StructType | None, filename: str | None, skip: int, pad: bool, drop: bool, options: dict) -> DataFrame:
    """CSV rows of text lines, with each line's file and without the leading lines of a file."""
    header = str(options.pop("header", "false")).lower() == "true"
    infer = str(options.pop("inferSchema", "false")).lower() == "true"
    # Rows of a file's first split have consecutive numbers, so its first number says which are the leading ones.
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    starts = text.where("at = 0").groupBy("file").agg(F.min("n").alias("first")).withColumnRenamed("file", "f")
    numbered = text.join(F.broadcast(starts), F.col("file") == F.col("f"))  # a row for each file
    place = F.when(F.col("at") == 0, F.col("n") - F.col("first")).otherwise(F.lit(1 << 62))
    body = numbered.where(place >= skip + header).where(F.length("value") > 0).select("value", "file")

    def as_text(frame: DataFrame) -> DataFrame:
        return DataFrame(getattr(frame.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING()), spark)

    def parsed(frame: DataFrame, **more) -> DataFrame:
        return DataFrame(spark.read.options(**options, **more)._jreader.csv(as_text(frame)._jdf), spark)

    if schema is None:
        # The widest row tells how many columns there are; its names are the header's, if there is one.
        wide = parsed(body.orderBy(F.length(F.regexp_replace("value", "[^" + options.get("sep", ",") + "]", "")).desc()).limit(1)) if pad and not header else None
        named = parsed(numbered.where(place == skip).orderBy("file").limit(1), header=True).columns if header else (wide or parsed(body)).columns
        types = [f.dataType for f in parsed(body, inferSchema=infer).schema]
        schema = StructType([StructField(name, types[k] if k < len(types) else StringType()) for k, name in enumerate(named)])
    elif isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    # Values are read as text and cast, so that a value that does not fit is told from a missing one.
    broken, plain = "__broken", StructType([StructField(f"c{k}", StringType()) for k in range(len(schema))])
    row = F.from_csv("value", ", ".join([*(f"{f.name} string" for f in plain), f"{broken} string"]), {**options, "columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE"})
    told = body.select("file", row.alias("r"), F.col("value"))
    cast = [F.expr(f"try_cast(r.c{k} AS {f.dataType.simpleString()})") for k, f in enumerate(schema)]
    misfit = F.lit(False)
    for k, value in enumerate(cast):
        misfit = misfit | (F.col(f"r.c{k}").isNotNull() & value.isNull())
    if drop:
        bad = misfit if pad else misfit | F.col(f"r.{broken}").isNotNull()
        told = told.where(~bad)
    return told.select(*(c.alias(f.name) for c, f in zip(cast, schema, strict=True)), *([F.col("file").alias(filename)] if filename else []))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Registers Parquet tables of a folder as temporary views."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
