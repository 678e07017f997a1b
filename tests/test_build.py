"""The build stops and goes on, and does nothing twice."""

from ashlar.schema import BODIES, EDGES, SYMBOLS
from ashlar.streaming import build
from ashlar.streaming.build import Index, percent


def test_resume(spark, tmp_path):
    symbols = spark.createDataFrame([(0, "A", "A", "A", "p.A")], SYMBOLS)
    edges = spark.createDataFrame([("A", "B", 1), ("A", "B", 1)], EDGES)
    texts = str(tmp_path / "texts")
    spark.createDataFrame([(1, "p.A", "p", 'a "lit" b'), (2, "p.B", "p", 'c "lit" "two"')], BODIES).coalesce(1).write.parquet(texts)
    index = Index(spark, str(tmp_path / "index"))
    assert index.status(2).first().state == "ABSENT"
    assert index.write_graph(symbols, edges) == ["symbols", "edges"]
    assert index.write_graph(symbols, edges) == []
    assert not index.complete()
    assert index.write_texts(texts, BODIES, files_a_batch=1) == 2
    assert index.complete()
    assert index.write_texts(texts, BODIES) == 0
    row = index.status(3).first()
    assert (row.state, row.indexed_classes, row.percent, row.symbols, row.edges, row.const_strings) == ("READY", 2, 66, 1, 2, 3)
    spark.createDataFrame([(3, "p.C", "p", '"new"')], BODIES).coalesce(1).write.mode("append").parquet(texts)
    assert index.write_texts(texts, BODIES) == 1
    assert index.status(3).first().const_strings == 4


def test_interrupted_phase_is_written_again(spark, tmp_path):
    symbols = spark.createDataFrame([(0, "A", "A", "A", "p.A")], SYMBOLS)
    edges = spark.createDataFrame([("A", "B", 1)], EDGES)
    index = Index(spark, str(tmp_path / "index"))
    edges.limit(0).write.parquet(f"{index.folder}/edges")  # begun, not marked
    assert index.write_graph(symbols, edges) == ["symbols", "edges"]
    assert spark.read.parquet(f"{index.folder}/edges").count() == 1


def test_main_package_first_and_versions(spark, tmp_path):
    texts = str(tmp_path / "texts")
    spark.createDataFrame([(1, "q.A", "q", "one"), (2, "p.B", "p", "two"), (3, "p.c.D", "p.c", "three"), (4, "E", None, "four")], BODIES).write.parquet(texts)
    index = Index(spark, str(tmp_path / "index"))
    assert index.check_version("1") is False and index.check_version("1") is True
    assert index.write_texts(texts, BODIES, main_package="p") == 4
    first = spark.read.parquet(f"{index.folder}/indexed").where("batch LIKE 'main%'")
    assert {r.cls_idx for r in first.collect()} == {2, 3}
    assert index.write_texts(texts, BODIES, main_package="p") == 0
    assert index.check_version("2") is False and not index.exists("indexed") and not index.complete()
    assert index.write_texts(texts, BODIES) == 4  # made anew


def test_cancel(spark, tmp_path, monkeypatch):
    texts = str(tmp_path / "texts")
    for k in range(3):
        spark.createDataFrame([(k, "p.A", "p", f"text {k}")], BODIES).coalesce(1).write.mode("append").parquet(texts)
    index = Index(spark, str(tmp_path / "index"))
    whole = build.write_postings

    def cancel_after_one(batch, path):
        whole(batch, path)
        index.cancelled = True

    monkeypatch.setattr(build, "write_postings", cancel_after_one)
    index.write_texts(texts, BODIES, files_a_batch=1)
    assert index.status(3).first().state == "FAILED" and not index.complete()
    monkeypatch.setattr(build, "write_postings", whole)
    index.write_texts(texts, BODIES)
    assert index.status(3).first().state == "READY" and index.status(3).first().indexed_classes == 3
    index.cancel()  # nothing runs


def test_percent():
    assert [percent(1, 3, False), percent(5, 3, False), percent(0, 0, True), percent(0, 0, False)] == [33, 100, 100, 0]
