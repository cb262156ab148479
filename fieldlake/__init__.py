"""Feature tables for crop-yield work, built as Spark jobs.

Every public function takes and returns DataFrames (or Columns); nothing here
reads a whole table into the driver or into one task.
"""

__version__ = "0.1.0"
