"""The phases of ``quality_phases``: each holds every answer, and its rows are dealt over the cores, not by their bytes."""

from caselens.plans import phases, retrieval


def test_dealt(spark):
    rows = spark.range(100).repartition(1)
    assert retrieval.dealt(rows).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_each_phase_has_all_answers(spark, tmp_path):
    turns = [(c, t, role, text) for c in range(3) for t, role, text in ((0, "user", "How to run?"), (1, "assistant", "Run it."), (2, "assistant", None))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = phases.quality_phases(spark, str(tmp_path)).collect()
    assert {r.phase: r.answers for r in rows} == {"plain": 6, "told": 6, "unsupported": 6}
    assert all(r.CustomerReady + r.NeedsReview + r.InsufficientEvidence + r.Blocked == 6 and 0 <= r.mean_grounding <= 1 for r in rows)
