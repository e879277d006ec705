"""End-to-end jobs over a folder of .eml files composed from the sf0.001 tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001


@pytest.fixture(scope="module")
def eml_dir(spark, tmp_path_factory):
    from mailsift.plans.q_mime import message_fixture
    from mailsift.sources.eml import write_messages
    root = str(tmp_path_factory.mktemp("eml"))
    n = write_messages(message_fixture(spark, SF001), root)
    assert n == 320            # 200 documents, 40 items in three odd layouts
    return root


def test_label_eml_directory(spark, eml_dir, tmp_path):
    from mailsift.plans.jobs import label_eml_directory
    from mailsift.sources.labelled import read_labelled_csv
    out = str(tmp_path / "a.csv")
    stats = label_eml_directory(spark, eml_dir, out, label=1)
    assert stats["found"] == 320 and stats["processed"] + stats["skipped"] == 320
    back = read_labelled_csv(spark, out)
    assert back.count() == stats["processed"]
    assert back.where(F.col("label") != 1).count() == 0
    assert back.where(F.length("email_text") < 50).count() == 0
    with pytest.raises(ValueError):
        label_eml_directory(spark, eml_dir, out, label=2)


def test_prepare_train_score_explain(spark, eml_dir, tmp_path):
    from mailsift.plans import jobs
    out = str(tmp_path / "b.csv")
    stats = jobs.prepare_training_data(spark, eml_dir, out, max_samples=60)
    assert stats["phishing"] == 30 and stats["legitimate"] == 30 and stats["total"] == 60
    model = str(tmp_path / "model")
    m = jobs.train(spark, out, model).collect()[0]
    assert m.tn + m.fp + m.fn + m.tp == 12          # int(60 * 0.2) validation rows
    texts = spark.createDataFrame([(1, "Your order has shipped. Thanks, John"), (2, "zzz")],
                                  "doc_id long, email_text string")
    scored = jobs.score(spark, model, texts).collect()
    assert len(scored) == 2 and all(0.0 <= r.p_1 <= 1.0 for r in scored)
    ex = jobs.explain(spark, model, texts).collect()
    assert all(r.rank <= 5 for r in ex)


def test_train_on_builtin_sample(spark, tmp_path):
    from mailsift.plans import jobs
    m = jobs.train(spark, None, str(tmp_path / "m")).collect()[0]
    assert m.tn + m.fp + m.fn + m.tp == 1           # max(1, int(6 * 0.2))


def test_label_job_agrees_with_ingest_and_subject_flag(spark, eml_dir, tmp_path):
    from mailsift.plans.jobs import label_eml_directory
    from mailsift.plans.q_mime import ingest
    from mailsift.sources.eml import scan_messages
    from mailsift.sources.labelled import read_labelled_csv
    ok = ingest(scan_messages(spark, eml_dir)).where(F.col("compact_status") == "ok")
    stats = label_eml_directory(spark, eml_dir, str(tmp_path / "a.csv"), label=0)
    assert stats["processed"] == ok.count()
    no_subj = str(tmp_path / "b.csv")
    label_eml_directory(spark, eml_dir, no_subj, label=0, include_subject=False)
    assert read_labelled_csv(spark, no_subj).where(F.col("email_text").startswith("Subject: ")).count() == 0


def test_preparation_counts_every_message_and_keeps_the_ratio(spark, tmp_path):
    from mailsift.plans import jobs
    folder = tmp_path / "mail"
    folder.mkdir()
    for i in range(12):
        body = f"This is a body of a message that is long enough, number {i % 10}, please read it. " * 2
        (folder / f"{i}.eml").write_bytes(f"Subject: s\r\n\r\n{body}\r\n".encode())
    (folder / "short.eml").write_bytes(b"Subject: s\r\n\r\nhi\r\n")
    stats = jobs.prepare_training_data(spark, str(folder), str(tmp_path / "out.csv"), max_samples=200, balance_ratio=3.0)
    assert (stats["found"], stats["parse_error"], stats["too_short"], stats["duplicate"], stats["collected"]) == (13, 0, 1, 2, 10)
    assert stats["legitimate"] == int(stats["phishing"] * 3.0)


def test_packed_messages_equal_the_scan(spark):
    """Listing in tasks and containers give the rows of the plain scan."""
    from mailsift.plans.q_mime import message_fixture
    from mailsift.session import scratch_path
    from mailsift.sources.eml import list_messages, pack_messages, packed_messages, scan_messages, write_messages
    root, out = scratch_path(spark, "t-folders"), scratch_path(spark, "t-containers")
    n = write_messages(message_fixture(spark, SF001), root, folders=7)
    write_messages(spark.createDataFrame([(1, "not a message")], "doc_id long, message string"), f"{root}/3", suffix=".txt")
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    scan = scan_messages(spark, root)
    listed = list_messages(spark, root)
    assert listed.count() == n == scan.count()
    assert listed.select(name, "length").exceptAll(scan.select(name, "length")).count() == 0
    containers = pack_messages(spark, root, out, target_bytes=100_000)
    packed = packed_messages(spark, out)
    assert packed.select(name, "length", "content").exceptAll(scan.select(name, "length", "content")).count() == 0
    assert packed.count() == n and containers >= scan.agg(F.sum("length")).first()[0] // 200_000
    assert 0 < len(packed.inputFiles()) <= containers


def test_packing_an_empty_tree(spark):
    import os

    from mailsift.session import scratch_path
    from mailsift.sources.eml import pack_messages, packed_messages
    root, out = scratch_path(spark, "t-nothing"), scratch_path(spark, "t-containers")
    os.makedirs(f"{root}/a")
    assert pack_messages(spark, root, out) == 0 and packed_messages(spark, out).count() == 0
