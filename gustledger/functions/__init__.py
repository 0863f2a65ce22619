"""Column-level helpers: null rules, time grid arithmetic and rounding."""
