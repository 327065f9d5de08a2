"""A PySpark-native knowledge-graph retrieval and evaluation engine."""

from pyspark import cloudpickle as _cloudpickle

import quillgraph as _self

# Python workers may not have this package on their path: ship its functions by value.
_cloudpickle.register_pickle_by_value(_self)
