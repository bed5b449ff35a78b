"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark plans (plain per-card windows and list
filters instead of slices, context rows and prefix tables) so that agreement
means something.  Shared CTEs live in :mod:`cardlens.oracle.ctes`.
"""

from cardlens.oracle.registry import oracle_sql

__all__ = ["oracle_sql"]
