"""Functions by name for SQL: each is an expression or a query that Catalyst inlines, so no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and arguments, result, body. The bodies are the SQL forms of ``music.note_name`` and of a pitch's key.
FUNCTIONS = (
    ("note_name(pitch INT)", "STRING", "concat(element_at(array('C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'), pmod(pitch, 12) + 1), CAST(floor(pitch / 12) - 1 AS STRING))"),
    ("is_black_key(pitch INT)", "BOOLEAN", "pmod(pitch, 12) IN (1, 3, 6, 8, 10)"),
    ("keys_between(low INT, high INT)", "TABLE (pitch INT, name STRING)", "SELECT p, note_name(p) FROM (SELECT explode(CASE WHEN low <= high THEN sequence(low, high) END) AS p)"),
)


def register(spark: SparkSession) -> None:
    """Make note_name, is_black_key and the table function keys_between known to the session. A null argument gives null
    or, for the table, no rows; so does a range that ends before it begins."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
