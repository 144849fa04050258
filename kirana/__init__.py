"""kirana: store and call analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Columns for the
scalar functions in ``kirana.functions``); nothing in the data path
collects to the driver.
"""

from kirana.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
