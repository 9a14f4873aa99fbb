"""recoflow: recommendation analytics as Spark DataFrame plans.

Every operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver in the data path.
"""

from recoflow.cols import Cols, DEFAULT

__all__ = ["Cols", "DEFAULT"]
