"""Which chart suits which columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dataloupe.functions.columns import is_numeric, require_columns
from dataloupe.plans.cardinality import distinct_up_to
from dataloupe.plans.storage import rows_up_to
from dataloupe.specs import ChartSpec

# Largest pie, and rows above which a violin replaces a box.
PIE_SLICES = 10
VIOLIN_ROWS = 1000


def chart_types(
    df: DataFrame,
    specs: list[ChartSpec],
    temporal_columns: list[str] | None = None,
    counts: dict[str, int | None] | None = None,
) -> list[str]:
    """The chart type of each spec. All specs share one distinct count and one row test,
    and neither runs if the column types already decide. ``counts`` are distinct counts, if they
    are known already, None for many."""
    times = temporal_columns or []
    kinds = [_kinds(df, s, times) for s in specs]
    pies = {s.x for s, k in zip(specs, kinds) if k[:2] == ("category", None)}
    counts = distinct_up_to(df, sorted(pies), PIE_SLICES) if counts is None else counts
    slices = {n for n in pies if counts[n] is not None and counts[n] <= PIE_SLICES}
    violins = ("category", "number", None) in kinds
    many = violins and rows_up_to(df, VIOLIN_ROWS + 1) > VIOLIN_ROWS
    return [_choice(k, s.x in slices, many) for s, k in zip(specs, kinds)]


def _kinds(df: DataFrame, spec: ChartSpec, times: list[str]) -> tuple[str | None, ...]:
    require_columns(df, spec.x, spec.y, spec.color_by)

    def kind(name: str | None) -> str | None:
        return name and ("number" if is_numeric(df, name) else "category")

    return ("time" if spec.x in times else kind(spec.x), kind(spec.y), kind(spec.color_by))


def _choice(kinds: tuple[str | None, ...], few: bool, many: bool) -> str:
    match kinds:
        case ("time", "number", "number"):
            return "twin_line"
        case ("time", "number" | None, _):
            return "line"
        case ("time", _, _):
            return "stacked_bar"
        case ("number", None, _):
            return "histogram"
        case ("category", None, _):
            return "pie" if few else "countplot"
        case ("number", "number", _):
            return "scatter"
        case ("number", _, _):
            return "box"
        case ("category", "number", None):
            return "violin" if many else "box"
        case ("category", "number", _):
            return "box"
        case (_, _, "number"):
            return "heatmap"
    return "stacked_bar"


def choose_chart(
    df: DataFrame, specs: list[ChartSpec], temporal_columns: list[str] | None = None
) -> DataFrame:
    """``(x, y, color, chart_type)``, one row per spec."""
    types = chart_types(df, specs, temporal_columns)
    rows = [(s.x, s.y, s.color_by, t) for s, t in zip(specs, types)]
    return df.sparkSession.createDataFrame(
        rows, "x string, y string, color string, chart_type string"
    )
