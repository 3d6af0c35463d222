"""Physical-scale helpers: size checks, written intermediates, lookup joins, exact quantiles."""
