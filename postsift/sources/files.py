"""Reading and writing posting tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def string_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def fill_missing(df: DataFrame) -> DataFrame:
    """Missing strings become ''."""
    return df.na.fill("")


def read_postings(spark: SparkSession, path: str, columns=None, fmt: str = "parquet") -> DataFrame:
    """Posting table with string columns only and '' for missing.

    CSV files may quote line breaks and start with a byte-order mark. Without
    ``columns`` a CSV header names them; nothing is inferred.
    """
    if fmt == "csv":
        reader = spark.read.options(header=True, multiLine=True, escape='"')
        if columns is not None:
            reader = reader.schema(string_schema(columns)).option("enforceSchema", False)
        return fill_missing(reader.csv(path))
    table = spark.read.parquet(path)
    names = columns or table.columns
    return fill_missing(table.select(*[F.col(c).cast("string").alias(c) for c in names]))


def with_load_order(df: DataFrame, source_rank: int) -> DataFrame:
    """Rank of the source and place in it, the order that "first" refers to.

    The place is the file's path, the part's offset in the file, and the row within the part,
    so it does not follow from how files were packed into tasks. ``df`` comes from files and
    has not been shuffled since.
    """
    file = F.col("_metadata")
    return df.withColumns({
        "source_rank": F.lit(source_rank),
        "ordinal": F.struct(file["file_path"].alias("file"), file["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("row")),
    })


def write_postings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                   partition_by=(), bom: bool = False) -> None:
    """Write a posting table. By default an existing table is never replaced.

    ``bom`` marks CSV text with a byte-order mark for spreadsheets: the first
    header cell carries it in every part file.
    """
    if bom and fmt == "csv":
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path)
    else:
        writer.parquet(path)


def write_annotations(df: DataFrame, path: str, force: bool = False, **kwargs) -> None:
    """Write an annotation batch; refuse to replace one that may hold labels."""
    write_postings(df, path, mode="overwrite" if force else "errorifexists", **kwargs)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that was scanned in fewer tasks than that.

    Text patterns cost far more than the scan, and a small table may be one
    file split. Large tables already have more splits than cores and pass as they are.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
