"""Voxel analytics on Spark: sampling grids, masks, fields and contours as DataFrames."""

import sys

from pyspark import cloudpickle

#: Kernels reach the executors by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
