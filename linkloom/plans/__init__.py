"""Plan-level helpers: staged tables, skew-safe ordering, level loops."""
