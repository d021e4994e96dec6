"""The text functions under SQL names, as SQL-bodied temporary functions.

Catalyst inlines the bodies, so queries that use them optimise like plain built-ins. For the
distinct concatenation use the built-in ``listagg(DISTINCT x, ',') WITHIN GROUP (ORDER BY x)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Function names that existing SQL text of the jobs uses.
SQL_FUNCTIONS = (
    "concat_long_string(id BIGINT, name STRING, sep STRING) RETURNS STRING "
    "RETURN concat(CAST(id AS STRING), sep, name)",
    "get_json_value(doc STRING, field STRING) RETURNS STRING "
    "RETURN get_json_object(doc, concat('$.', field))",
)


def register_sql_functions(spark: SparkSession) -> None:
    for definition in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
