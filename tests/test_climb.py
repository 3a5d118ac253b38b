"""Hill climbing: each stop rule, decisions, crashes, restarts."""

import pytest

from vellum.operators import climb
from vellum.operators.climb import Change, Stops


def runs(spark, scores):
    return spark.createDataFrame([(e, float(x)) for e, own in scores.items() for x in own], "eval string, score double")


def row(n, score, decision, target=None, failing=(), size=0):
    return {"round": n, "score": score, "decision": decision, "target": target, "failing": list(failing), "size": size}


def test_grades_and_decisions(spark):
    assert climb.graded(runs(spark, {"a": [1, 0, 1], "b": [0.5, 1, 0.7]})) == (0.85, ["b"])
    assert climb.graded(runs(spark, {})) == (None, [])
    log = [row(1, 0.5, "keep", size=4), row(2, 0.4, "revert")]
    assert [climb.decide(log, s, n) for s, n in ((0.6, 9), (0.5, 3), (0.5, 4), (0.4, 1), (None, 0))] == ["keep", "keep", "revert", "revert", "revert"]
    assert climb.decide([], 0.0, 1) == "keep"


def test_stop_rules():
    stops = Stops(rounds=6, idle=3, stubborn=2)
    perfect = [row(1, 0.5, "keep"), row(2, 1.0, "keep"), row(3, 1.0, "revert")]
    assert climb.stopped(perfect, stops) is None and climb.stopped([*perfect, row(4, 1.0, "revert")], stops) == "perfect"
    flat = [row(1, 0.1, "keep"), row(2, 0.2, "keep"), *[row(n, 0.1, "revert") for n in range(3, 7)]]
    assert climb.stopped(flat[:5], stops) is None and climb.stopped(flat, stops) == "plateau"
    late = [*[row(n, 0.1, "revert") for n in range(1, 5)], row(5, 0.9, "keep"), row(6, 0.1, "revert"), row(7, 0.1, "revert")]
    assert climb.stopped(late, stops) is None and climb.stopped([*late, row(8, 0.1, "revert")], stops) == "plateau"
    simpler = [row(1, 0.5, "keep", size=9), *[row(n, 0.5, "keep", size=9 - n) for n in range(2, 7)]]
    assert climb.stopped(simpler, stops) == "plateau"  # only simpler, no better
    hard = [row(1, 0.5, "keep", failing=("a", "b")), row(2, 0.4, "revert", "a"), row(3, 0.4, "revert", "a"), row(4, 0.4, "revert", "b")]
    assert climb.stopped(hard, stops) is None and climb.stopped([*hard, row(5, 0.4, "revert", "b")], stops) == "stubborn"


@pytest.mark.parametrize("budget", [None, 2])
def test_same_decisions_after_restarts(spark, tmp_path, budget):
    scores = [0.2, 0.5, 0.4, None, 0.5, 0.9, 0.9]

    def propose(log):
        return Change(f"change {len(log)}", "a", 10 - len(log)) if len(log) < len(scores) else None

    def evaluate(change):
        score = scores[int(change.name.split()[1])]
        if score is None:
            raise ValueError("broken idea")
        return runs(spark, {"a": [0, score, 1], "b": [score]})

    path, calls = f"file://{tmp_path}/log", 0
    while (why := climb.climb(spark, path, propose, evaluate, budget=budget)) == "budget":
        calls += 1
        if calls == 1:  # the call was cut off while it wrote: no row of that round
            (tmp_path / "log/round=000003").mkdir()
    assert why == "done" and calls == (0 if budget is None else 3)
    log = sorted(climb.history(spark, path).collect(), key=lambda r: r["round"])
    assert [(r["score"], r["decision"]) for r in log] == [(0.2, "keep"), (0.5, "keep"), (0.4, "revert"), (None, "revert"), (0.5, "keep"), (0.9, "keep"), (0.9, "keep")]
    assert log[3].error == "ValueError: broken idea"
