"""Sources (S1-S4).

All readers use fixed schemas (no inference).  :func:`spread` is an option for
callers whose input is one small file (one split): it deals the rows out anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .csv_records import read_csv
from .versions import current

RAW_CSV_SCHEMA = T.StructType([
    T.StructField("ID", T.LongType()),
    T.StructField("Resume_str", T.StringType()),
    T.StructField("Category", T.StringType()),
])

PREPARED_COLUMNS = ["Filename", "Name", "Email", "Category", "Skills", "Education", "Full_Text",
                    "gender_proxy", "institution_tier", "career_gap", "name_origin_proxy"]
PREPARED_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in PREPARED_COLUMNS])

PARSED_COLUMNS = ["Filename", "Name", "Email", "Skills", "Education", "Full_Text",
                  "gender_proxy", "institution_tier", "career_gap", "name_origin_proxy"]


def spread(df: DataFrame, partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Hash-repartition by ``key`` (round-robin without one) into the number of
    partitions that the caller asks for; none asked for leaves the scan as it is."""
    if not partitions:
        return df
    return df.repartition(partitions, key) if key else df.repartition(partitions)


# -- S1: a folder of text files, one document per file ---------------------------------

def read_text_dir(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(file_name, text): every ``*{suffix}`` file of ``path`` as one row.
    A missing folder (Spark's own error) or one without matching files is an error."""
    df = (spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}")
          .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")))
    if df.isEmpty():
        raise FileNotFoundError(f"no *{suffix} files in {path}")
    return df


def parse_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """S1 + the parser: the parsed row of every file, ordered by file name."""
    raw = read_text_dir(spark, path).withColumnRenamed("file_name", "Filename")
    return tx.parse_frame(raw, "text", ["Filename"]).orderBy("Filename")


# -- S2 / S3: CSV -----------------------------------------------------------------------

def read_raw_csv(spark: SparkSession, path: str, by_blocks: bool = False) -> DataFrame:
    """Header CSV ``ID, Resume_str, Category``; quoted fields may hold newlines.
    ``by_blocks``: a large file is read by many tasks (see :mod:`.csv_records` for
    the form that files must have), else each file by one."""
    if by_blocks:
        return read_csv(spark, path, RAW_CSV_SCHEMA)
    return (spark.read.schema(RAW_CSV_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def read_prepared(spark: SparkSession, path: str, fmt: str = "parquet", by_blocks: bool = False) -> DataFrame:
    """Re-read the preparation job's output (the latest version, if it was
    published); empty strings come back as ''."""
    path = current(spark, path)
    if fmt == "csv" and by_blocks:
        df = read_csv(spark, path, PREPARED_SCHEMA)
    elif fmt == "csv":
        df = (spark.read.schema(PREPARED_SCHEMA).option("header", True).option("multiLine", True)
              .option("escape", '"').csv(path))
    else:
        df = spark.read.parquet(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in PREPARED_COLUMNS])


# -- S4: inline rows ----------------------------------------------------------------------

def parse_inline(spark: SparkSession, named_texts: dict[str, str]) -> DataFrame:
    """Rows given as ``name -> text``; the name comes from the key, the other
    columns from the parser."""
    rows = [(name.replace(" ", "_") + ".txt", name, text) for name, text in named_texts.items()]
    df = spark.createDataFrame(rows, "Filename string, Name string, text string")
    return tx.parse_frame(df, "text", ["Filename"], F.col("Name"))
