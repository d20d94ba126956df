"""The progress sink: records of a live run, and what they are made of."""

from nearwin.queries import QUERIES
from nearwin.streaming import progress
from tests.conftest import DATA


def told(run, batch, rows, ms, stores=((3, 100),)):
    return {"runId": run, "batchId": batch, "numInputRows": rows, "durationMs": {"triggerExecution": ms}, "stateOperators": [{"numRowsTotal": n, "memoryUsedBytes": b} for n, b in stores]}


def test_steps_add_up():
    log = progress.Progress()
    for of in (told("a", 0, 100, 2000), told("b", 0, 7, 1000), told("a", 1, 0, 50), told("a", 1, 50, 500, ((4, 10), (1, 5))), told("a", 2, 10, 0, ())):
        log.took(of)
    assert [(s.run, s.batch, s.evaluation_instances, s.total_train_time, s.total_train_speed, s.last_train_time, s.last_train_speed, s.model_instances, s.model_bytes) for s in log.steps] == [
        ("a", 0, 100, 2.0, 50.0, 2.0, 50.0, 3, 100), ("b", 0, 7, 1.0, 7.0, 1.0, 7.0, 3, 100), ("a", 1, 150, 2.5, 60.0, 0.5, 100.0, 5, 15), ("a", 2, 160, 2.5, 64.0, 0.0, 0.0, 0, 0),
    ]
    lines = list(log.lines())
    assert lines[0].startswith("run,batch,evaluation_instances") and lines[1].startswith("a,0,100,2.0,50.0") and len(lines) == 5


def test_report_of_a_live_run(spark):
    got = QUERIES["eval_report"](spark, DATA).collect()
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert got and max(r["evaluation_instances"] for r in got) == events.count()
    users = events.select("user_id").distinct().count()
    assert max(r["model_instances"] for r in got) == users and all(r["model_bytes"] > 0 and r["total_train_speed"] > 0 for r in got)
    assert 0 <= got[0]["accuracy_pct"] <= 100 and got[0]["classified_instances"] <= events.count()
