"""Independent DuckDB SQL oracles for the registered queries (used by the correctness gate)."""
