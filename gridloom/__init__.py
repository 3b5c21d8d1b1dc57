"""gridloom: a Spark-native engine for gridded space-time panels.

Every operator is a pure ``DataFrame -> DataFrame`` function.  Nothing here
relies on row position; panels are keyed by ``(grid_id, month_idx)``.
"""

__version__ = "0.1.0"
