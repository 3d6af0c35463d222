"""Data quality, profiling, outliers and chart data on Spark DataFrames."""

from dataloupe.operators.battery import (
    ChartResult, chart_battery, chart_data, explorer_query, facet, fold_tail, plan_battery,
    run_chart, run_chart_query, tidy_chart,
)
from dataloupe.operators.chart_choice import chart_types, choose_chart
from dataloupe.operators.charts import (
    axis_limits, bar_mean, box_stats, category_share, composition, count_plot, events_over_time,
    heatmap, histogram, kde, line_mean, rolling_mean, rolling_mean_by_days, rolling_window, scale_kind,
    scatter_cells, scatter_points, scatter_sample, twin_line, violin,
)
from dataloupe.operators.clean import (
    CleanReport, apply_processing_plan, clean, coerce_timestamp, drop_columns, drop_duplicates,
    drop_null_rows, duplicate_row_count, null_cell_count, rename_columns,
)
from dataloupe.operators.features import (
    add_calendar_features, add_day_name, add_days_between, add_difference, add_month_name,
    add_product, add_ratio, add_sum, add_year, apply_recipes, day_span, time_span,
)
from dataloupe.operators.outliers import (
    clip_outliers, clip_thresholds, dispersion, iqr_outliers, outliers_by_group, outliers_global,
)
from dataloupe.operators.profile import (
    cardinality_warning, categorical_profile, distinct_counts, null_percent, numeric_profile,
    profile, semantic_types, skew_hint,
)
from dataloupe.operators.repair import impute, zscore_filter
from dataloupe.operators.summary import concentration, forensic_summary, normalized_entropy
from dataloupe.operators.topk import category_pareto, category_totals, top_categories, top_k_others
from dataloupe.operators.triage import (
    finding_outcome, triage_findings, unfinished_runs, with_tweak_history,
)
from dataloupe.plans.storage import release
from dataloupe.sources import (
    clean_names, preview, read_table, require_min_rows, sample_rows, sanitize_columns, write_results,
)
from dataloupe.specs import ChartSpec, FeatureRecipe, ProcessingPlan, Tweak
