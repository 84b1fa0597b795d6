"""One module for each operator: QUERIES, and ORACLE_SQL where SQL can express it."""
