from earshot.operators import labels


def test_a_decision_on_an_actor_without_segments_counts_for_its_group(spark):
    segments = spark.createDataFrame([(a, "R", 100.0, False) for a in (11, 11, 11, 11, 11, 21, 22)], "actor long, region string, duration double, is_excluded boolean")
    decisions = spark.createDataFrame([(10, "keep", "heard", "Q", 1), (20, "reject", "", "", 2), (22, "keep", "", "", 3), (30, "keep", "", "", 4)], "actor long, decision string, reason string, resolved_region string, order int")
    same = spark.createDataFrame([(11, 10), (21, 20), (22, 20)], "a long, b long")
    got = {(r.actor, r.speaker_final, r.speaker_decision, r.speaker_reason, r.final_dialect, r.exclusion_rule) for r in labels.freeze(segments, decisions, same).collect()}
    assert got == {(11, 10, "keep", "heard", "Q", ""), (21, 20, "reject", "", "R", "decision"), (22, 20, "keep", "", "R", "dust")}
