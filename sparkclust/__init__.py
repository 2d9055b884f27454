"""sparkclust: K-means clustering and text features as Spark DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python code shipped to tasks (Arrow batch functions) is pickled by value, so
# executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .operators.assign import assign, distances, predict
from .operators.rowindex import group_offsets, partition_sizes, with_row_index
from .operators.seed import centers_frame, seed_first_k
from .plans.kmeans import KMeansRun, fit
from .sources.points import parse_point_lines, points_from_array, points_from_columns, read_lines, read_points, split_rejects

__all__ = [
    "KMeansRun",
    "assign",
    "centers_frame",
    "distances",
    "fit",
    "group_offsets",
    "parse_point_lines",
    "partition_sizes",
    "points_from_array",
    "points_from_columns",
    "predict",
    "read_lines",
    "read_points",
    "seed_first_k",
    "split_rejects",
    "with_row_index",
]
