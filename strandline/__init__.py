"""Threshold-exceedance analysis of environmental sampling programmes on Spark.

Every public function takes and returns DataFrames (or builds Columns); nothing
here pulls rows to the driver.
"""

from strandline.model import Limits

__all__ = ["Limits"]
