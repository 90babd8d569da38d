"""Order-line sales analytics as Spark jobs.

Flat order lines go in; a cleaned and enriched line table, a star schema, a
library of business queries and a small measure layer come out.  Everything is
DataFrame or Spark SQL code that stays on the executors.
"""

__version__ = "0.1.0"
