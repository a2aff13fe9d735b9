"""Independent DuckDB SQL for every registered query (the correctness oracle)."""

from oracle.registry import ORACLE, query  # noqa: F401
