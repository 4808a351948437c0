"""Problem 3: window texts that no successful export has handed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.incremental import Delta, pending
from quire.session import scratch_dir, table


def window_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the current version of the lines."""
    return table(spark, d, "semantic_recipe_v4").select(F.explode("windows.key").alias("key"))


def delta(spark: SparkSession, d: str) -> Delta:
    """How the current lines differ from what the committed runs of the log have handed over."""
    return pending(window_keys(spark, d), table(spark, d, "vector_record"), table(spark, d, "export_run"), scratch_dir(spark, "p3"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys (lower case) that still have to be processed."""
    return delta(spark, d).added


def p3_obsolete(spark: SparkSession, d: str) -> DataFrame:
    """Keys handed over by a committed run whose text is gone from the lines: the removals of the same delta."""
    return delta(spark, d).removed


QUERIES = {"p3_found": p3_found, "p3_obsolete": p3_obsolete}

_LAST = """
    SELECT key, max(run_id) FILTER (WHERE action = 'put') AS p, max(run_id) FILTER (WHERE action = 'drop') AS d
    FROM (SELECT lower(key) AS key, run_id, action FROM vector_record
          WHERE run_id IN (SELECT run_id FROM export_run WHERE status = 'succeeded')) GROUP BY key"""
_NOW = "SELECT DISTINCT lower(w.key) AS key FROM (SELECT unnest(windows) AS w FROM semantic_recipe_v4) WHERE w.key IS NOT NULL"

SQL = {
    "p3_found": f"WITH last AS ({_LAST}), cur AS ({_NOW}) SELECT key FROM cur WHERE key NOT IN (SELECT key FROM last WHERE p IS NOT NULL AND (d IS NULL OR d < p))",
    "p3_obsolete": f"WITH last AS ({_LAST}), cur AS ({_NOW}) SELECT key FROM last WHERE p IS NOT NULL AND (d IS NULL OR d < p) AND key NOT IN (SELECT key FROM cur)",
}
