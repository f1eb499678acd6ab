"""Workforce-management analytics as Spark DataFrame transformations.

Subpackages:
  sources    - table readers, adapters from the test tables, CSV / planner-grid ingest, sinks
  functions  - column expressions: cleaning, dates, text, clamped math
  operators  - roll-ups, planner shaping, datamart, look-alike scenarios, features, models, activity
  streaming  - Structured Streaming sessionization
  plans      - the registered query catalogue and its DuckDB oracle SQL
"""

from staffwise.session import get_spark, checkpoint_dir  # noqa: F401
