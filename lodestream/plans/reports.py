"""Small frames as markdown: the data-quality report, run summaries side by side, a run's report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from lodestream.operators import bulletins


def markdown(columns: list[str], rows: list[tuple]) -> str:
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([line(columns), "|" + "---|" * len(columns), *(line(["-" if v is None else str(v) for v in r]) for r in rows)])


def quality_report(table: DataFrame, cities: DataFrame) -> str:
    """Coverage and gaps of the listed cities (one line each)."""
    f = bulletins.load_stats(table).first()
    g = bulletins.gap_report(table, cities).orderBy("city")
    notes = ["`days_category_only`: the category is known, the value isn't.", "`mean_station_coverage_pct`: mean of reporting over all stations on reported days.", "Missing days aren't filled in."]
    head = f"# Data quality of the daily bulletins\n\nRange {f.first_day} to {f.last_day}; {f.cities} cities; {f.n_rows} city-days.\n"
    return "\n".join([head, markdown(g.columns, [tuple(r) for r in g.collect()]), "", *(f"- {n}" for n in notes)]) + "\n"


def compare_runs(runs: Mapping[str, Mapping[str, float]]) -> str:
    """Summaries of runs, a row each; a missing metric is a dash."""
    names = sorted({k for r in runs.values() for k in r})
    return markdown(["run", *names], [(run, *(r.get(k) for k in names)) for run, r in runs.items()])


def run_report(name: str, summary: Mapping[str, float], by_category: DataFrame) -> str:
    lines = [f"# {name}", "", markdown(["metric", "value"], list(summary.items())), "", "## By category", ""]
    return "\n".join([*lines, markdown(by_category.columns, [tuple(r) for r in by_category.orderBy(*by_category.columns[:1]).collect()])]) + "\n"
