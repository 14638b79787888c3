"""Figures of the queries that may grow no faster than their input: what they shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from quire.derive import word_blocks, word_pages
from quire.operators import layout, reading, scope, search
from quire.operators.pages import page_rows
from quire.queries import QUERIES


@pytest.fixture(scope="module")
def many_splits(spark, tmp_path_factory):
    """Documents in more files than there are cores, which are read as they lie."""
    d = str(tmp_path_factory.mktemp("splits"))
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.col("doc_id") * 37 % 400), lambda i: F.concat(F.lit("the and idiot w").substr(i % 9, i % 7 + 1), (i * 7919 % 50).cast("string"))), " ")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit(0).alias("x")).withColumn("text", words).drop("x").repartition(12).write.parquet(f"{d}/documents.parquet")
    yield d
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    return re.findall(r"Exchange (\w+\([^)]*\))", plan)


#: Queries of words, and how many times a row of theirs is shuffled.
SHUFFLES = {
    "label_right_value": 1,
    "scope_merge_rules": 0,
    "regex_search": 0,
    "scope_normalize": 0,
    "has_regex": 1,
    "reading_lines": 0,
    "scope_merge": 0,
    "reading_text": 1,
    "scope_filter": 0,
    "search_region": 0,
    "search_overlap": 0,
    "dedupe_chars": 0,
    "dedupe_blocks": 0,
}


@pytest.mark.parametrize("name", list(SHUFFLES))
def test_words_are_not_dealt_by_page(spark, many_splits, name):
    found = exchanges(QUERIES[name](spark, many_splits))
    assert len(found) == SHUFFLES[name] and not any("page_index" in x for x in found)


def test_pages_and_rows_have_the_same_answers(spark, many_splits):
    rows, pages = word_blocks(spark, many_splits), word_pages(spark, many_splits)
    region = search.R.Rectangle(100.0, 50.0, 500.0, 300.0)
    for f in (
        reading.lines, reading.text,
        lambda b: search.search_regex(b, r"\d\s+[a-z]+\d"), lambda b: search.has_regex(b, "id"), lambda b: search.right_of_label(b, "t", 150.0),
        lambda b: scope.scoped(b, region, 0.4), lambda b: scope.scoped(b, region, 0.1, 60.0, True, scope.MergeRules(True, True)),
    ):
        one, other = f(rows), f(pages)
        assert one.columns == other.columns and one.count() > 0
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_labels_reach_other_pages(spark):
    """Blocks beside a label count on any page of its document, as their places are on one tall page."""
    box = "struct<top: double, left: double, bottom: double, right: double>"
    b = spark.createDataFrame([("d", 0, 0, "due", (0.0, 0.0, 10.0, 20.0)), ("d", 1, 1, "5", (2.0, 30.0, 9.0, 40.0)), ("e", 2, 0, "6", (2.0, 30.0, 9.0, 40.0))], f"doc_id string, block_id long, page_index int, text string, bbox {box}")
    assert [tuple(r) for r in search.right_of_label(b, "due", 50.0).collect()] == [("d", 0, 0, "due", 1, "5")]


@pytest.mark.parametrize("name", ["split_label", "split_boundary"])
def test_blocks_are_split_in_one_pass(spark, many_splits, name):
    """Blocks with and without a match go the same way, so the documents are read once."""
    plan = QUERIES[name](spark, many_splits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan


def test_pages_are_deduplicated_as_rows_are(spark):
    nan = float("nan")
    box = "struct<top: double, left: double, bottom: double, right: double>"
    boxes = [(0.0, 0.0, 1.0, 1.0), (-0.0, 0.0, 1.0, 1.0), (nan, 0.0, 1.0, 1.0), (nan, 0.0, 1.0, 1.0), (0.0, 2.0, 1.0, 3.0), None]
    b = spark.createDataFrame([("d", i, i % 2, "ab"[i % 3 % 2], boxes[i % 6]) for i in range(40)], f"doc_id string, block_id long, page_index int, text string, bbox {box}").where("bbox IS NOT NULL")
    want, got = layout.dedupe_blocks(b), layout.dedupe_blocks(page_rows(b))
    assert sorted((r.page_index, r.block_id) for r in want.collect()) == sorted((r.page_index, r.block_id) for r in got.collect())


@pytest.mark.parametrize("name", ["pdf_pages", "pdf_roundtrip_blocks", "pdf_roundtrip_text"])
def test_batches_of_documents_are_bounded(spark, many_splits, name):
    """A worker holds some MB of documents at once, not ten thousand of them."""
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(most, str(256 << 20))
    QUERIES[name](spark, many_splits)
    assert int(spark.conf.get(most)) <= 4 << 20
