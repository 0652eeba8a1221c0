"""DataFrame operators: profiling, aggregation, lookups, statistics, models, exploration."""
