"""Hill climbing over changes: one Spark job a round, state in a table, stop rules, restarts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "round int, change string, target string, size long, score double, failing array<string>, decision string, error string"


@dataclass(frozen=True)
class Change:
    """What a round tries: ``target`` is the evaluation it is meant to mend, ``size`` its complexity."""

    name: str
    target: str | None = None
    size: int = 0


@dataclass(frozen=True)
class Stops:
    """Fixed values of the rules: a perfect score in so many rounds in a row; so many rounds, the last few without improvement; so many failed tries at every evaluation that still fails."""

    perfect: float = 1.0
    perfect_rounds: int = 3
    rounds: int = 20
    idle: int = 5
    stubborn: int = 5


def graded(runs: DataFrame, perfect: float = 1.0) -> tuple[float | None, list[str]]:
    """The mean over evaluations of the median over runs, and which evaluations fall short; ``runs``: eval, run score. None without a score."""
    medians = runs.where("score is not null").groupBy("eval").agg(F.percentile("score", F.lit(0.5)).alias("median"))
    r = medians.agg(F.round(F.avg("median"), 6).alias("score"), F.sort_array(F.collect_list(F.when(F.col("median") < perfect, F.col("eval")))).alias("failing")).first()
    return r.score, list(r.failing)  # a name for each evaluation


def decide(log: list[dict], score: float | None, size: int) -> str:
    """keep or revert, by the best kept round before: better is kept, equal if simpler, without a score never."""
    kept = [r for r in log if r["decision"] == "keep"]
    if score is None:
        return "revert"
    if not kept:
        return "keep"
    best = kept[-1]
    return "keep" if score > best["score"] or (score == best["score"] and size < best["size"]) else "revert"


def stopped(log: list[dict], stops: Stops) -> str | None:
    """The rule that ends the loop after the rounds of ``log``, or None."""
    last = log[-stops.perfect_rounds :]
    if len(last) == stops.perfect_rounds and all(r["score"] is not None and r["score"] >= stops.perfect for r in last):
        return "perfect"
    best, improved = None, 0
    for r in log:  # a kept round that is only simpler is no improvement
        if r["decision"] == "keep" and (best is None or r["score"] > best):
            best, improved = r["score"], r["round"]
    if len(log) >= stops.rounds and log[-1]["round"] - improved >= stops.idle:
        return "plateau"
    kept = [r for r in log if r["decision"] == "keep"]
    if kept and kept[-1]["failing"]:
        since = [r for r in log if r["round"] > kept[-1]["round"]]
        tries = {e: sum(r["target"] == e for r in since) for e in kept[-1]["failing"]}
        if all(n >= stops.stubborn for n in tries.values()):
            return "stubborn"
    return None


def history(spark: SparkSession, path: str) -> DataFrame:
    """The rounds so far."""
    try:
        return spark.read.schema(STATE).parquet(f"{path}/round=*")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], STATE)


def climb(spark: SparkSession, path: str, propose: Callable[[list[dict]], Change | None], evaluate: Callable[[Change], DataFrame], stops: Stops = Stops(), budget: int | None = None) -> str:  # noqa: B008
    """Try what ``propose`` makes of the rounds so far until a rule stops, nothing is proposed ("done") or ``budget`` rounds of this call are over ("budget").

    ``evaluate`` gives the runs of a change (eval, score), on whole tables. A change whose
    evaluation fails is reverted and logged with its error. A round is one row,
    written before the next begins under its number, so a call that was cut off goes on
    where it ended, with the same decisions. The driver holds a row a round.
    """
    log = [r.asDict() for r in sorted(history(spark, path).collect(), key=lambda r: r["round"])]
    done = 0
    while True:
        if log and (why := stopped(log, stops)):
            return why
        if budget is not None and done >= budget:
            return "budget"
        change = propose(log)
        if change is None:
            return "done"
        score, failing, error = None, [], None
        try:
            score, failing = graded(evaluate(change), stops.perfect)
        except Exception as broken:
            error = f"{type(broken).__name__}: {str(broken).splitlines()[0] if str(broken) else ''}"[:200]
        row = {"round": len(log) + 1, "change": change.name, "target": change.target, "size": change.size, "score": score, "failing": failing, "decision": decide(log, score, change.size), "error": error}
        spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/round={row['round']:06d}")
        log.append(row)
        done += 1
