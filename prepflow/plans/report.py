"""The sections of a data report as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.operators import profile as prof
from prepflow.operators import readiness

SECTIONS = ("overview", "columns", "health", "top_values", "readiness", "issues")


def report_tables(
    df: DataFrame,
    target: str | None = None,
    changelog: DataFrame | None = None,
    metrics: DataFrame | None = None,
    sections: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The sections of a report on ``df`` (all, or those asked for); the stage it describes is the table passed in.

    Statistics are found once per kind: one profile for the column sections, one set of
    scores for the readiness sections, and neither if no section needs it.
    """
    known = {n: t for n, t in (("changelog", changelog), ("models", metrics)) if t is not None}
    wanted = [*SECTIONS, *known] if sections is None else list(sections)
    unknown = [n for n in wanted if n not in SECTIONS and n not in known]
    if unknown:
        raise ValueError(f"no sections {unknown}; have {', '.join([*SECTIONS, *known])}")
    if set(wanted) & {"columns", "health", "top_values"}:
        p = prof.profile(df)
        known |= {
            "overview": p.table(),
            "columns": prof.column_stats_table(p),
            "health": prof.column_health(p),
            "top_values": p.top_frame(),
        }
    elif "overview" in wanted:
        known["overview"] = prof.table_profile(df)
    if set(wanted) & {"readiness", "issues"}:
        found = readiness.scores(df, target)
        known |= {
            "readiness": readiness.readiness_score(df, target, found),
            "issues": readiness.readiness_issues(df, target, found),
        }
    return {n: known[n] for n in wanted}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet table per section below ``path``; sections hold a few rows per column."""
    for name, table in tables.items():
        table.select(*[F.col(f"`{c}`") for c in table.columns]).coalesce(1).write.mode("errorifexists").parquet(
            f"{path}/{name}"
        )
