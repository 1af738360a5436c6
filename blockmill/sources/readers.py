"""Files as blocks, and text columns as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.hashing import draw_order
from blockmill.functions.itemsets import canonical
from blockmill.functions.vectors import array_to_vector, features_of, label_of
from blockmill.operators.blocks import BLOCK, blocks_at
from blockmill.runtime import join_checked

#: The schemas of the two side tables.
GOODS_SCHEMA = "name string, price double, Type string"
ITEMSET_CSV_SCHEMA = "fim string, freq int"


def _same_path(path: Column) -> Column:
    """One spelling for the paths that the readers report in two."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_replace(plain, "^file:/+", "file:/")


#: Reader options that decide which files are read.
_FILE_OPTIONS = ("recursiveFileLookup", "pathGlobFilter", "modifiedBefore", "modifiedAfter")


def file_catalog(
    spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, **options
) -> DataFrame:
    """(path, length) of every file; lists the files without opening them.

    ``options`` that choose files are those of the readers.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    chosen = {k: v for k, v in options.items() if k in _FILE_OPTIONS}
    if pattern is not None:
        chosen["pathGlobFilter"] = pattern
    return spark.read.format("binaryFile").options(**chosen).load(names).select("path", "length")


def read_blocks(
    spark: SparkSession, paths: str | Sequence[str], fmt: str = "parquet", **options
) -> DataFrame:
    """Read csv, json, parquet, orc or text files, one block per file.

    Blocks are numbered from 0 by file length, longest first, so the first n
    blocks are the n largest files. How Spark splits or packs the files into
    tasks makes no difference to ``block_id``. ``options`` go to the reader and,
    as far as they choose files, to the listing; a row of a file that is not
    listed is an error.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.format(fmt).options(**options).load(names)
    columns = rows.columns
    # One entry per file, so the listing is gathered as a whole.
    numbered = (
        file_catalog(spark, names, **options)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("k"), "path"))).alias("a"))
        .select(F.posexplode("a").alias("pos", "file"))
        .select(_same_path(F.col("file.path")).alias("_path"), F.col("pos").cast("bigint").alias("_number"))
    )
    placed = rows.select("*", _same_path(F.col("_metadata.file_path")).alias("_path"))
    joined = join_checked(
        placed, numbered, ["_path"], len(rows.inputFiles()), F.monotonically_increasing_id(), "left"
    )
    missing = F.raise_error(F.concat(F.lit("file is not listed: "), "_path"))
    return joined.select(*columns, F.coalesce("_number", missing.cast("bigint")).alias(BLOCK))


def read_text_blocks(
    spark: SparkSession, paths: str | Sequence[str], delimiter: str | None = None, **options
) -> DataFrame:
    """(value, block_id): text records, one file per block."""
    if delimiter:
        options["lineSep"] = delimiter
    return read_blocks(spark, paths, "text", **options)


def read_stored_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks kept in one directory each; filters on ``block_id`` skip directories."""
    return spark.read.parquet(path)


def stored_block_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the blocks below ``path``, from the names of the files alone."""
    number = F.regexp_extract("path", f"/{BLOCK}=([0-9]+)/", 1)
    files = file_catalog(spark, path, "*.parquet", recursiveFileLookup="true")
    return files.where(number != "").select(number.cast("bigint").alias(BLOCK)).distinct()


def random_stored_blocks(spark: SparkSession, path: str, n: int, seed: int = 42) -> DataFrame:
    """Rows of ``n`` stored blocks drawn without replacement; none if there are fewer.

    Draws what ``random_blocks`` draws of the same blocks, but no row is read to
    find the ids, and only the directories drawn are opened.
    """
    ids = stored_block_ids(spark, path).orderBy(draw_order(seed, F.col(BLOCK)), BLOCK).limit(n)
    drawn = [row[BLOCK] for row in ids.collect()]
    return blocks_at(read_stored_blocks(spark, path), drawn if len(drawn) == n else [])


def random_files(spark: SparkSession, folder: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` random Parquet files of a table's folder; all of them when there are fewer.

    The draw goes by the path below the folder, so a table that is moved gives
    the same files.
    """
    catalog = file_catalog(spark, folder, "*.parquet", recursiveFileLookup="true")
    below = F.element_at(F.split(F.col("path"), F.lit(f"/{folder.rstrip('/').split('/')[-1]}/")), -1)
    return catalog.orderBy(F.hash(F.lit(seed), below), below).limit(n)


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows of the Parquet files named by ``path``; their number is the caller's."""
    return spark.read.parquet(*[row["path"] for row in files.select("path").collect()])


def csv_column(text: Column | str, schema: str) -> Column:
    """Parse CSV text held in a column into a struct."""
    return F.from_csv(text, schema)


def json_column(text: Column | str, schema: str) -> Column:
    """Parse JSON text held in a column into a struct."""
    return F.from_json(text, schema)


def basket_of(text: Column) -> Column:
    """Space-separated ints to a basket."""
    return canonical(F.split(F.trim(text), " +").cast("array<int>"))


def labelled_vectors(lines: DataFrame, text: str = "value") -> DataFrame:
    """Comma-separated numbers, the last one the label, to (label, features)."""
    return lines.withColumn("label", label_of(F.col(text))).withColumn(
        "features", array_to_vector(features_of(F.col(text)))
    ).drop(text)


def read_goods(spark: SparkSession, path: str) -> DataFrame:
    """(name, price, type) from JSON lines, where the last field is spelt ``Type``."""
    return spark.read.schema(GOODS_SCHEMA).json(path).withColumnRenamed("Type", "type")


def read_itemset_csv(spark: SparkSession, path: str) -> DataFrame:
    """Mined itemsets written as CSV: key and count."""
    return spark.read.schema(ITEMSET_CSV_SCHEMA).csv(path)
