from pyspark.sql import functions as F

from cinderlake.operators import evaluation


def test_groups_of_draws_are_not_sent_to_the_driver(spark):
    own = spark.range(500).select(F.col("id").alias("k"), *[(F.col("id") % 7 + c).alias(n) for c, n in enumerate(("inter_a", "union_a", "inter_b", "union_b"), 1)])
    out = evaluation.window_bootstrap(own, "k", draws=20)
    assert "SortMergeJoin [place" in out._jdf.queryExecution().sparkPlan().toString()
    assert out.first().groups == 500
    # places of a draw are as many as groups, from 1 on
    drawn = evaluation.drawn_groups(own, 3, "x").groupBy("draw").agg(F.count("*").alias("n"), F.min("place").alias("a"), F.max("place").alias("b")).collect()
    assert sorted(r.draw for r in drawn) == [1, 2, 3] and all(r.n == 500 and r.a >= 1 and r.b <= 500 for r in drawn)


def test_an_error_report_reads_its_rows_twice(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0, 2, 3), (2, 1, "a", 5, 0, 1), (3, 2, "a", 0, 1, 1), (1, 1, "b", 3, 0, 0), (3, 2, "b", 0, 0, 2)], "sample_id long, group_id long, model string, tp long, fp long, fn long")
    got = {r.model: r for r in evaluation.error_report(rows).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].fn, got["a"].missed_samples, got["a"].missed_groups, got["a"].shared_truth) == (5, 3, 5, 2, 1, False)
    assert (got["b"].missed_samples, got["b"].missed_groups) == (1, 1)
    plan = evaluation.error_report(rows)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2
