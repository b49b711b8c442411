from . import lifecycle, queries, states  # noqa: F401  the others add their queries to those of queries
