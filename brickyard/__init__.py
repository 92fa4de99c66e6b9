"""brickyard: property-market analytics as PySpark DataFrame jobs.

sources/    canonical tables (derived, stored once, raw registers), sinks
functions/  column expressions: rounding, labels, cleaning, windows
operators/  exact grouped quantiles with bounded task state; scalar subqueries
plans/      the jobs, their registry and their DuckDB oracle SQL
streaming/  the register loader as an exactly-once file stream
"""

__version__ = "0.1.0"
