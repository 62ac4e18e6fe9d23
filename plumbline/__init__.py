"""A Spark-native engine for imperfect data: fuzzy predicates, per-row veracity and a change log with time travel."""
