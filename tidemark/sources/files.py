"""File landing: raw rows keep the value, the file it came from and the load time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"


def as_landed(rows: DataFrame, value: Column, *extra: Column) -> DataFrame:
    """(raw_data, filename, ingestion_time) of file-backed rows."""
    return rows.select(
        value.alias("raw_data"),
        F.col("_metadata.file_path").alias("filename"),
        F.current_timestamp().cast("timestamp_ntz").alias("ingestion_time"),
        *extra,
    )


def land_parquet(
    spark: SparkSession, path: str, schema: StructType | None = None
) -> DataFrame:
    """Parquet rows as one semi-structured value each."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = reader.parquet(path)
    fields = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return as_landed(rows, F.to_variant_object(fields))


def land_json(spark: SparkSession, path: str, whole_documents: bool = False) -> DataFrame:
    """One JSON value per row; text that does not parse is kept with a null value
    and as it is in ``raw_text``.

    By default a line is a value.  With ``whole_documents`` a file is one document
    over any number of lines, and a top-level array is one row per element.  Such
    files are read by one task each.
    """
    rows = spark.read.text(path, wholetext=whole_documents)
    value = F.try_parse_json("value")
    if not whole_documents:
        return as_landed(rows, value, F.col("value").alias("raw_text"))
    elements = F.try_variant_get(value, "$", "array<variant>")
    each = rows.select(
        "value", "_metadata",
        F.explode(F.coalesce(elements, F.array(value))).alias("element"),
    )
    return as_landed(each, F.col("element"), F.col("value").alias("raw_text"))


def land_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    null_tokens: tuple[str, ...] = ("", "NULL"),
    multi_line: bool = True,
) -> DataFrame:
    """Typed CSV rows: header skipped, fields optionally quoted, null tokens of any
    column turned to null, rows that do not fit kept in ``_corrupt_record``.

    Every field is read as text first; a row is bad if it has too few or too many
    fields, or a text other than a null token that is no value of its type.  Quoted
    fields may hold line breaks, so a file is read by one task; large files without
    them are split with ``multi_line=False``.
    """
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields])
    rows = spark.read.csv(
        path,
        schema=texts.add(CORRUPT, StringType()),
        header=True,
        quote='"',
        escape='"',
        multiLine=multi_line,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
        enforceSchema=True,
    )
    plain, typed, misfit = [], [], F.lit(False)
    for field in schema.fields:
        text = F.col(field.name)
        plain.append(F.coalesce(text, F.lit("")).alias(field.name))
        for token in null_tokens:
            text = F.nullif(text, F.lit(token))
        value = text.try_cast(field.dataType)
        misfit = misfit | (text.isNotNull() & value.isNull())
        typed.append(value.alias(field.name))
    as_text = F.to_csv(F.struct(*plain), {"escape": '"', "quote": '"'})
    bad = F.coalesce(F.col(CORRUPT), F.when(misfit, as_text))
    return rows.select(
        *typed, bad.alias(CORRUPT), F.col("_metadata.file_path").alias("filename")
    )


def quarantine_files(
    spark: SparkSession, path: str, quarantine: str, pattern: str = "*"
) -> DataFrame:
    """Files of a folder that are no Parquet files, appended to a quarantine table.

    Land the others with :func:`land_parquet` and ``ignoreCorruptFiles``.  A Parquet
    file begins and ends with ``PAR1``; a file cut off in transfer does not.  Damage
    inside a file shows only when its rows are read.
    """
    files_ = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    head = F.substring("content", 1, 4).cast("string")
    tail = F.substring("content", -4, 4).cast("string")
    whole = (F.col("length") >= 12) & (head == "PAR1") & (tail == "PAR1")
    files_.where(~whole).select(
        F.col("path").alias("filename"), "length", F.col("modificationTime").alias("modified_at"),
        F.lit("not a whole Parquet file").alias("error"),
        F.current_timestamp().alias("quarantined_at"),
    ).write.mode("append").parquet(quarantine)
    return spark.read.parquet(quarantine)


def split_bad_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows of a landed table.

    Landed JSON is bad when its value is null, typed rows when the corrupt
    record column is filled.
    """
    if CORRUPT in df.columns:
        bad = F.col(CORRUPT).isNotNull()
        return df.where(~bad).drop(CORRUPT), df.where(bad)
    bad = F.col("raw_data").isNull()
    return df.where(~bad), df.where(bad)


def flatten_snapshot(snapshots: DataFrame) -> DataFrame:
    """Station rows of nested network snapshots.

    ``snapshots`` holds ``network.stations`` (an array of structs with a nested
    ``extra``) and ``extraction_at``.  Nested fields keep their dotted names, as
    a flattened payload would carry them.
    """
    one = snapshots.select(
        F.explode("network.stations").alias("s"), F.col("extraction_at")
    )
    station = one.schema["s"].dataType
    plain = [F.col(f"s.{f.name}") for f in station.fields if f.name != "extra"]
    nested = [
        F.col(f"s.extra.{f.name}").alias(f"extra.{f.name}")
        for f in station["extra"].dataType.fields
    ]
    return one.select(*plain, *nested, "extraction_at")
