"""Registered queries: labelled CSV round trip (S2 S4) and model persistence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_masked
from ..operators.classify import load_model, nb_fit, nb_predict, save_model
from ..session import scratch_path
from ..sources.labelled import read_labelled_csv, write_labelled_csv
from ..sources.tables import labelled_documents
from . import sqltext as S
from .corpus import prepare_corpus
from .q_model import _nb_sql
from .registry import register


@register("csv_roundtrip", f"""
SELECT {S.clean_masked('d.text')} AS email_text, CAST(l.toxic AS INTEGER) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def csv_roundtrip(spark, base):
    """S4 then S2: cleaned labelled rows (multi-line cells) written as CSV and read back."""
    rows = labelled_documents(spark, base).select(clean_masked("text").alias("email_text"), "label")
    path = scratch_path(spark, "csv-roundtrip")
    write_labelled_csv(rows, path)
    return read_labelled_csv(spark, path)


@register("csv_in_splits", """
SELECT d.text AS email_text, CAST(l.toxic AS INTEGER) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def csv_in_splits(spark, base):
    """S2 for large files: whole labelled texts, written as CSV, read split by split."""
    path = scratch_path(spark, "csv-splits")
    write_labelled_csv(labelled_documents(spark, base).select("text", "label"), path, text_col="text")
    return read_labelled_csv(spark, path, in_splits=True)


@register("model_save_load", _nb_sql(1.0) + """
SELECT doc_id, round(p1, 6) AS p_1, pred FROM pred""")
def model_save_load(spark, base):
    """Fit, save the model tables, load them back and score the validation part."""
    corpus = prepare_corpus(spark, base)
    table, priors = nb_fit(corpus.where(F.col("part") == "train"), "email_text", "label", 1.0)
    path = scratch_path(spark, "nb-model")
    save_model(table, priors, path)
    t2, p2 = load_model(spark, path)
    s = nb_predict(corpus.where(F.col("part") == "val"), t2, p2)
    return s.select("doc_id", F.round("p_1", 6).alias("p_1"), "pred")
