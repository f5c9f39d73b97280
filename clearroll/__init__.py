"""clearroll: validation, scoring and monitoring of directory records on Spark.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing collects data rows to the driver and nothing runs a Python
UDF per row.  Time is always a parameter (``as_of``), never the wall clock.
"""

from .session import build_session, shared_checkpoint_dir

__all__ = ["build_session", "shared_checkpoint_dir"]
