"""Independent DuckDB SQL for the registered queries and the harness comparing both."""
