import pytest
from pyspark.sql import functions as F

from treeloom.llm import common as C
from treeloom.llm.exact_dedup import exact_dedup
from treeloom.llm.katz import katz_scores
from treeloom.llm.near_copies import near_distinct_documents
from treeloom.llm.records import write_records
from treeloom.llm.simhash import simhash_groups
from treeloom.llm.substring_dedup import substring_dedup


def test_group_numbers_follow_the_input_and_joins_do_not_inflate_them(spark, sf, docs):
    own = docs.select("doc_id", "text")
    assert C.parts(own, 1000) > C.parts(own, 100_000) >= 4
    joined = own.join(docs.select("doc_id", "lang"), "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    assert C.input_bytes(joined) <= 3 * C.input_bytes(docs)
    assert C.parts(spark.createDataFrame([(1,)], "a int")) == 4


def test_shared_folder_is_taken_from_the_session(spark):
    path = C.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == path == C.shared_dir(spark)
    assert C.scratch(spark, "x").startswith(path)
    assert C.cut(spark.range(5).repartition(4), files=1).agg(F.count(F.lit(1))).first()[0] == 5


def test_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "id int, row string")
    keep = spark.createDataFrame([(1, 2), (None, 1)], "k int, n int")
    out = C.one_of_each(docs, {"k": F.col("id")}, keep)
    assert sorted(map(str, out.collect())) == sorted(["Row(id=1, row='a')", "Row(id=None, row='b')"])


def test_ids_must_be_integers(spark):
    """Text ids are refused before any job, by every operator that orders by id."""
    docs = spark.createDataFrame([("a1", "x"), ("b2", "y")], "doc_id string, text string")
    for f in (exact_dedup, substring_dedup, simhash_groups, near_distinct_documents, lambda d: katz_scores(d, F.lit(True)), lambda d: write_records(d, C.scratch(spark, "r"), "none")):
        with pytest.raises(TypeError, match="must hold integers"):
            f(docs)


def test_scratch_is_released(spark):
    path = C.scratch(spark, "gone")
    spark.range(3).write.parquet(path)
    C.release(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        C.shared_dir(Session())


def test_groups_are_sized_by_counting_where_statistics_are_unknown(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(500)], "doc_id bigint, text string")
    monkeypatch.setattr(C, "input_bytes", lambda df: 1 << 61)
    assert C.parts(docs, 10_000) >= 500 * 1000 * 2 // 10_000


def test_a_run_after_a_lost_task_is_whole(spark, tmp_path):
    """A task dies (here without retries, so the run fails); what it left behind changes nothing."""
    mark = str(tmp_path / "died")
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(100)], "doc_id bigint, text string")

    def once(batches):
        import os

        for b in batches:
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("lost")
            yield b

    flaky = docs.mapInArrow(once, docs.schema)
    with pytest.raises(Exception, match="lost"):
        exact_dedup(flaky).collect()
    assert sorted(map(str, exact_dedup(flaky).collect())) == sorted(map(str, exact_dedup(docs).collect()))
