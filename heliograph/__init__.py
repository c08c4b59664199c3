"""Entity analytics on PySpark: schemas, a query builder, search, change logs and live queries."""

from pyspark import cloudpickle

import heliograph as _self

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(_self)
