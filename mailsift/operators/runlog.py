"""Run log (C4): what a scoring run found and how long it took, from one observed pass.

A run is executed once, without collecting its rows: ``observe`` counts rows and confusion while they
are written to the null sink, the wall time of that pass divided by its rows is the latency of a
message, and both become one row of a Parquet log that any later session can read and rank.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "run string, params map<string,double>, rows bigint, tn bigint, fp bigint, fn bigint, tp bigint, " \
             "recall double, accuracy double, seconds double, ms_per_row double"


def logged_run(scored: DataFrame, run: str, log_path: str, params: dict[str, float] | None = None,
               label_col: str = "label", pred_col: str = "pred") -> dict:
    """Execute ``scored`` (a row per message with its label and prediction) and append its row to the log."""
    seen = Observation(f"run {run}")
    cell = lambda y, p: F.count_if((F.col(label_col) == y) & (F.col(pred_col) == p))
    observed = scored.observe(seen, F.count(F.lit(1)).alias("rows"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                              cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    start = time.monotonic()
    observed.write.format("noop").mode("overwrite").save()
    seconds = time.monotonic() - start
    m = seen.get
    rows, positives = m["rows"], m["tp"] + m["fn"]
    row = {"run": run, "params": params or {}, **m, "recall": m["tp"] / positives if positives else 0.0,
           "accuracy": (m["tp"] + m["tn"]) / rows if rows else 0.0, "seconds": seconds,
           "ms_per_row": 1000 * seconds / rows if rows else 0.0}
    names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    scored.sparkSession.createDataFrame([tuple(row[c] for c in names)], LOG_SCHEMA).coalesce(1) \
        .write.mode("append").parquet(log_path)
    return row


def rank_runs(log: DataFrame) -> DataFrame:
    """The runs of a log by recall, then accuracy, then the smaller latency, then name, with their rank.
    One window over a row per run."""
    w = Window.orderBy(F.col("recall").desc(), F.col("accuracy").desc(), F.col("ms_per_row"), F.col("run"))
    return log.select("run", "rows", "recall", "accuracy", "ms_per_row", F.row_number().over(w).cast("bigint").alias("rank"))
