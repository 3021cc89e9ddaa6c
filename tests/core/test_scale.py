"""Plans and values that only larger tables would show: no broadcast of exploded rows, work spread over tasks, sums in any order."""

import pytest
from pyspark.sql import functions as F

from packlens.functions import garble, text
from packlens.operators import classify, quality
from packlens.plans import label_queries, register
from packlens.sources import adapters as A

DATA = "/root/testdata/sf0.001"
KEYS = ["scan_id", "photo", "line_no"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chosen_votes", "votes_or_none", "mode_notes", "line_edits", "extract_manufacturer", "extract_block_text", "extract_product", "product_fields", "kept_confidence"])
def test_lines_are_not_broadcast(spark, name):
    """Spark takes exploded lines for as few as the parts they come from."""
    assert "Broadcast" not in plan(register.QUERIES[name](spark, DATA))


def test_only_the_model_is_broadcast(spark):
    for name in ("ngram_score", "pruning_ladder"):
        shown = plan(register.QUERIES[name](spark, DATA))
        assert shown.count("BroadcastExchange") == 2 and "BuildLeft" not in shown, shown
    lines = spark.createDataFrame([(1, "net net net x"), (2, "zzz"), (3, None)], "id int, text string")
    idf, weights = spark.createDataFrame([("net", 2.0)], "gram string, idf double"), spark.createDataFrame([(1, "net", 3.0)], "class_no int, gram string, weight double")
    bias = spark.createDataFrame([(0, "a", 0.0), (1, "b", 0.0)], "class_no int, class string, bias double")
    assert {r.id: r.vote_class for r in classify.scored(lines, idf, weights, bias, "id").collect()} == {1: "b", 2: "a", 3: "a"}


def test_label_lines_come_from_many_tasks(spark):
    """The parts are one small file, which one task would read and explode."""
    many = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert A.label_lines(spark, DATA).rdd.getNumPartitions() == many
    # and a photo's lines are gathered where they are
    assert plan(A.label_lines(spark, DATA).groupBy("scan_id", "photo").count()).count("Exchange") == 1


def test_a_mean_does_not_depend_on_the_order_of_photos(spark):
    rows = [(1, i, c, 1, 1) for i, c in enumerate((0.1, 0.2, 0.3))]
    for order in (rows, rows[::-1]):
        photos = spark.createDataFrame([*order, (2, 0, float("nan"), 1, 1), (2, 1, None, None, None)], "scan_id int, photo int, mean_conf double, chars int, regions int").coalesce(1)
        assert {r.scan_id: r.mean_confidence for r in quality.capture_quality(photos).collect()} == {1: 0.6 / 3, 2: 0.0}


def test_block_texts_of_the_sql_fit_little_memory():
    """A window's string_agg loses texts where it doesn't fit; a group's does not."""
    assert "string_agg" in label_queries.BLOCK and " OVER " not in label_queries.BLOCK


def test_shared_values_are_in_a_plan_once(spark):
    """An edit's hash was computed for each of its draws, a word's nearest for each of its uses."""
    df = spark.createDataFrame([("a", "Sodum Protoin")], "id string, text string")
    said = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert said(garble.copies(df)).count("md5(") == 1
    assert said(df.select(text.snapped(F.col("text")).alias("s"))).count("levenshtein(") == 1
    assert df.select(text.fixed_line(F.col("text"))).first()[0] == "Sodium Protein"
