"""tessera: event-warehouse and operations analytics on Spark.

Every public function takes and returns DataFrames (or Columns); the heavy
lifting is left to Catalyst/Tungsten.  See README.md for the module map.
"""

__version__ = "0.1.0"
