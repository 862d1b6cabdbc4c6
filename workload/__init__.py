"""The operators on the given test tables: inputs, queries, and DuckDB checks."""
