"""Column-level helpers: dialect rules, special functions, hash draws."""
