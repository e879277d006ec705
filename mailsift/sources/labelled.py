"""Labelled sources: constant labels per source (S5/S6), the built-in sample (S3) and the
labelled CSV format (S2/S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED_SCHEMA = T.StructType([T.StructField("email_text", T.StringType(), True),
                                T.StructField("label", T.IntegerType(), True)])

# FIXED VALUES: the six-row demonstration sample used when no training file is given.
BUILTIN_SAMPLE = (
    ("Estimado usuario, su cuenta necesita verificación urgente. Haga clic en el enlace.", 1),
    ("Recordatorio de la reunión mensual mañana a las 10 AM en la sala principal.", 0),
    ("Se detectó actividad sospechosa. Restablezca su contraseña inmediatamente.", 1),
    ("Gracias por su compra, adjuntamos la factura.", 0),
    ("Su correo excede el límite. Valide su cuenta ahora para evitar suspensión.", 1),
    ("Invitación al almuerzo del equipo este viernes.", 0),
)


def label_whole_source(df: DataFrame, label: int, source: str) -> DataFrame:
    """Every row of one source gets the same label and provenance."""
    if label not in (0, 1):
        raise ValueError("label must be 0 (legitimate) or 1 (phishing)")
    return df.withColumn("label", F.lit(int(label))).withColumn("source", F.lit(source))


def builtin_sample(spark: SparkSession) -> DataFrame:
    """S3: the demonstration sample."""
    return spark.createDataFrame(list(BUILTIN_SAMPLE), LABELLED_SCHEMA)


def write_labelled_csv(df: DataFrame, path: str, text_col: str = "email_text", label_col: str = "label") -> None:
    """``email_text,label`` with a header; every cell quoted so multi-line text survives."""
    (df.select(F.col(text_col).alias("email_text"), F.col(label_col).cast("int").alias("label"))
     .write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", "UTF-8")
     .csv(path))


#: Every cell with a quote, comma or line end is quoted, and quotes inside cells are doubled.
_CSV_OPTIONS = {"multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
                "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}


def read_labelled_csv(spark: SparkSession, path: str, in_splits: bool = False) -> DataFrame:
    """The labelled CSV with an explicit schema (no inference), multi-line cells. A task reads a
    file; with ``in_splits`` it reads a split of one (:func:`read_csv_splits`)."""
    if in_splits:
        return read_csv_splits(spark, path, LABELLED_SCHEMA)
    return spark.read.schema(LABELLED_SCHEMA).options(header=True, **_CSV_OPTIONS).csv(path)


def read_csv_splits(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV files with a header line and multi-line cells, where large files are read in splits.

    A line end separates records when an even number of quotes stands before it in the file. Quotes are
    counted per split first; a running sum over the splits of a file (a row each) tells whether a split
    begins inside a cell. Lines are then put together inside their split, and only the first and last
    piece of each split meet those of other splits. Text is read twice and shuffled once, by split.

    Files must quote cells that hold quotes, as :func:`write_labelled_csv` does (a cell such as ``5" disk``
    must not stand unquoted). Blank lines between records are skipped. Compressed files are one split."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value", F.regexp_count("value", F.lit('"')).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("own")) \
        .select("file", "block", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("outside"))

    here = Window.partitionBy("file", "block")
    above = here.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = here.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quotes = F.col("outside") + F.coalesce(F.sum("quotes").over(above), F.lit(0))
    pieces = lines.join(splits, ["file", "block"]) \
        .withColumn("begins", F.when(quotes % 2 == 0, F.col("line"))) \
        .withColumn("start", F.last("begins", ignorenulls=True).over(upto)) \
        .groupBy("file", "block", "start").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("rows")) \
        .select("file", "block", "start", F.array_join("rows.value", "\n").alias("text"),
                ((F.col("block") == 0) & (F.col("start") == F.min("start").over(here))).alias("header"),
                (F.col("start") < F.max("start").over(here)).alias("inner"))
    whole = pieces.where("inner").select("text", "header")
    in_order = Window.partitionBy("file").orderBy("block", F.col("start").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = pieces.where("inner is not true").withColumn("record", F.last("start", ignorenulls=True).over(in_order)) \
        .groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "start", "text"))).alias("parts"),
                                       F.bool_or("header").alias("header")) \
        .select(F.array_join("parts.text", "\n").alias("text"), "header")
    records = whole.unionByName(across).where(~F.coalesce("header", F.lit(False))) \
        .select(F.regexp_replace("text", r"\r\z", "").alias("text")).where("text <> ''")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("text", ddl, _CSV_OPTIONS).alias("r")).select("r.*")
