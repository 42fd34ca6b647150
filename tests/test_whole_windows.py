"""Row subsets that a registered query once took."""

from vestige.workload import score_queries


def test_labelled_merge_takes_windows_of_any_length(spark, monkeypatch):
    host = spark.createDataFrame([("t", 1, 1)], "trace_id string, pid long, ts_ns long")
    spans = spark.createDataFrame([("t", k, k, 10, 10 + k) for k in (0, 1, 20, 21, 500)], "trace_id string, use_id long, k long, lo long, hi long")
    monkeypatch.setattr(score_queries.v, "host", lambda spark, sf: host)
    monkeypatch.setattr(score_queries.v, "spans", lambda spark, sf: spans)
    monkeypatch.setattr(score_queries.corpora, "label", lambda h, meta, windows: windows)
    monkeypatch.setattr(score_queries.scoring, "run_trials", lambda labelled, mode: labelled)
    assert {r["use_id"] for r in score_queries.labelled_merge_scores(spark, "").collect()} == {"u0", "u1", "u20", "u21", "u500"}
