"""Reading the corpus tables.

Parquet is read lazily and only the columns a job names are requested, so Catalyst prunes
the scan (``ReadSchema``) and pushes ``where`` predicates into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(base_dir: str, name: str) -> str:
    return f"{base_dir.rstrip('/')}/{name}.parquet"


def spread(df: DataFrame) -> DataFrame:
    """Give a *small* scan a round-robin repartition over all task slots.

    A table whose scan plans into no more splits than there are task slots is at most
    ``slots × spark.sql.files.maxPartitionBytes`` bytes, and when it is stored as one or a few
    row groups only those few tasks would do the per-row text work; spreading it costs a
    bounded shuffle. A large table plans into many more splits than slots and is left alone,
    so no shuffle is ever added at scale. (Only the scan is planned; nothing runs.)
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() <= slots:
        return df.repartition(slots)
    return df


#: Documents whose tokens one task groups at once.
DOCS_PER_TASK = 2048


def dealt_by_key(df: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``df``, of ``n_rows`` whole texts, dealt by ``key``: later groupings and windows by the key, alone or with other
    columns, find their rows in place, so the texts are shuffled once and not the many rows made of them.
    The tasks grow with the rows, so that what one of them groups stays in memory."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(slots, -(-n_rows // DOCS_PER_TASK)), key)


def read_table(spark: SparkSession, base_dir: str, name: str, *columns: str,
               parallel: bool = False) -> DataFrame:
    df = spark.read.parquet(table_path(base_dir, name))
    df = df.select(*columns) if columns else df
    return spread(df) if parallel else df


def documents(spark: SparkSession, base_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, base_dir, "documents", *columns, parallel=True)


def labels(spark: SparkSession, base_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, base_dir, "labels", *columns)


def pages(spark: SparkSession, base_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, base_dir, "pages", *columns, parallel=True)


def labelled_documents(spark: SparkSession, base_dir: str, label_col: str = "toxic") -> DataFrame:
    """``documents ⋈ labels`` on ``doc_id``; ``label`` = the chosen 0/1 label column.

    Both sides are keyed on ``doc_id``; the join is an equi-join that Spark plans as a
    broadcast when the labels side is measured small (AQE) and a sort-merge join otherwise.
    """
    d = documents(spark, base_dir, "doc_id", "text", "source")
    lab = labels(spark, base_dir, "doc_id", label_col).withColumnRenamed(label_col, "label")
    return d.join(lab, "doc_id", "inner").withColumn("label", lab["label"].cast("int"))
