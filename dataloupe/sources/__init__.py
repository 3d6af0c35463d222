from dataloupe.sources.names import clean_names, sanitize_columns
from dataloupe.sources.tables import preview, read_table, require_min_rows, sample_rows, write_results

__all__ = [
    "clean_names", "preview", "read_table", "require_min_rows",
    "sample_rows", "sanitize_columns", "write_results",
]
