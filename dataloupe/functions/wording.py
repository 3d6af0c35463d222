"""Texts and limits that are part of the results."""

# Result texts and cut-offs that reports and charts must show exactly.
OUTLIER_SUMMARY = (
    "Stat Alert: %d extreme outliers (Max: %.2f) hidden. "
    "They represent %.1f%% of total {metric} value."
)
NO_OUTLIERS = "No significant outliers."
SPAN_MESSAGE = "Data spans %d days (From %s to %s)."
NO_TEMPORAL = "No temporal data identified. Skip temporal features."
NOT_TEMPORAL = "Column {column} is not in datetime format."
ALL_NULL_TEMPORAL = "Temporal column contains only null values."
HIGH_SKEW = "High Skew (Consider Log)"
NORMAL_RANGE = "Normal Range"
OTHERS = "Others"
GLOBAL_GROUP = "Global"

NUMERIC_ACTS = (
    "BASELINE: '{metric}' shows a median of %.2f with a CV of %.2f.",
    "DIVERGENCE: We found %d extreme events representing %.1f%% of volume. Kurtosis is %.2f.",
    "LEVER: Focus on the %d records exceeding the %.2f threshold to stabilize the North Star. \n"
    " Alert if {metric} > %.2f",
)
CATEGORICAL_ACTS = (
    "BASELINE: '{metric}' is dominated by '%s' (%.1f%% share).",
    "DIVERGENCE: The structure is highly %s (Entropy: %.2f) across %d unique categories.",
    "LEVER: Prioritize the '%s' segment for immediate scale, as it represents the core driver of the"
    " Primary Metric. \n Monitor %s retention. Consolidate %d variants",
)


def template(text: str, metric: str) -> str:
    """Put a metric name into a printf template, escaping its percent signs."""
    return text.replace("{metric}", metric.replace("%", "%%"))
