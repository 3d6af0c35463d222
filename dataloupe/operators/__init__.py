"""The operators: cleaning, features, profiling, outliers, summaries, top-k and charts."""
