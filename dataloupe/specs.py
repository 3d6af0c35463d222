"""Plain descriptions of what to do; the choices a user makes."""

from __future__ import annotations

from dataclasses import dataclass, field

# The recipe and tweak kinds.
RECIPE_KINDS = ("division", "subtraction", "multiplication", "addition", "temporal")
TWEAKS = ("rolling_mean", "unpin_y_zero", "log_scale", "facet_grid", "color_by_segment")


@dataclass(frozen=True)
class ProcessingPlan:
    """Columns to parse as time, to drop and to rename, all by their original names."""

    drop_columns: tuple[str, ...] = ()
    temporal_columns: tuple[str, ...] = ()
    column_mapping: dict[str, str] = field(default_factory=dict)
    time_formats: tuple[str, ...] = ()

    def renamed(self, name: str) -> str:
        return self.column_mapping.get(name, name)


@dataclass(frozen=True)
class FeatureRecipe:
    """One derived column. ``left`` and ``right`` are the operands in reading order
    (numerator and denominator, minuend and subtrahend, the two factors or addends);
    a temporal recipe names only ``left``."""

    kind: str
    new_name: str | None = None
    left: str | None = None
    right: str | None = None


@dataclass(frozen=True)
class ChartSpec:
    x: str
    y: str | None = None
    color_by: str | None = None
    score: int = 10
    title: str = ""

    @property
    def level(self) -> str:
        given = (self.y is not None) + (self.color_by is not None)
        return ("univariate", "bivariate", "multivariate")[given]


@dataclass(frozen=True)
class Tweak:
    """A requested change of one chart."""

    kind: str
    facet_by: str | None = None
    color_by: str | None = None

    def __post_init__(self):
        if self.kind not in TWEAKS:
            raise ValueError(f"unknown tweak {self.kind!r}; known: {TWEAKS}")
