"""S2 read in splits: the same rows as the reader that takes whole files, wherever the splits fall."""

import random

import pytest
from pyspark.sql import functions as F

from mailsift.sources.labelled import read_labelled_csv, write_labelled_csv


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def split_bytes(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, n)
    spark.conf.set(key, old)


@pytest.mark.parametrize("size", [64, 333, 5000])
def test_cells_across_splits(spark, tmp_path, split_bytes, size):
    rng = random.Random(size)
    parts = ['"', '""', "\n", "\n\n", ",", "word", "größer", "漢", " ", "a,b", '"\n"', "0,1\n"]
    texts = ["x" + "".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(300)]
    texts += ["line\n" * 400, '"' * 51, None, " blanks ", texts[0]]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "email_text string, label int")
    path = str(tmp_path / "csv")
    write_labelled_csv(df.repartition(2), path)
    split_bytes(size)
    got = read_labelled_csv(spark, path, in_splits=True)
    lines = spark.read.text(path).select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).distinct()
    assert lines.count() > 3                      # the files do fall into splits
    assert _rows(got) == _rows(read_labelled_csv(spark, path))
    assert [t for t, _ in _rows(got)].count(texts[0]) == 2


def test_line_ends_blank_lines_and_empty_files(spark, tmp_path, split_bytes):
    (tmp_path / "a.csv").write_bytes(b'email_text,label\r\n"one\r\ntwo",1\r\n\r\nplain,0\r\n')
    (tmp_path / "b.csv").write_bytes(b"email_text,label\n")
    (tmp_path / "c.csv").write_bytes(b'email_text,label\n"no end, ""quoted""",1')
    for size in (7, 1000):
        split_bytes(size)
        assert _rows(read_labelled_csv(spark, str(tmp_path), in_splits=True)) == \
            [('no end, "quoted"', 1), ("one\r\ntwo", 1), ("plain", 0)]


def test_text_is_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_labelled_csv(spark.range(100).selectExpr("concat('a\nb', id) AS email_text", "1 AS label"), path)
    df = read_labelled_csv(spark, path, in_splits=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # whole records and pieces across splits read one shuffle of the lines
    assert plan.count("Union") == 1 and "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan
