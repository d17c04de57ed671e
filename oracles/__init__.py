"""DuckDB SQL that recomputes the registered queries by other means."""
