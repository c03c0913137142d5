"""Batch scoring into a sink, with its log entry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.plans.model import ScoringModel, score
from tablewright.sources.sinks import append_log, write_scored


@dataclass(frozen=True)
class BatchResult:
    path: str
    row_count: int
    avg_confidence: float | None


def score_batch(
    df: DataFrame,
    model: ScoringModel,
    path: str,
    log: str | None = None,
    project_id: int = 0,
    user_id: int = 0,
    fmt: str = "parquet",
    clip: bool = False,
) -> BatchResult:
    """Write scored rows and log how many there were and how sure the model was.

    The two numbers are observed while the rows are written, so nothing is read back.
    """
    scored, seen = observed(score(df, model, clip), model)
    write_scored(scored, path, fmt)
    n, confidence = seen.get["n"], seen.get["c"]
    if log is not None:
        append_log(df.sparkSession, log, project_id, user_id, model.name, "batch", n, confidence)
    return BatchResult(path, n, confidence)


def observed(scored: DataFrame, model: ScoringModel) -> tuple[DataFrame, Observation]:
    """Scored rows and what their next action will have seen of them: ``n`` rows, mean probability ``c``."""
    seen = Observation()
    confidence = F.avg("probability") if model.target.is_classification else F.max(F.lit(None).cast("double"))
    return scored.observe(seen, F.count(F.lit(1)).alias("n"), confidence.alias("c")), seen
