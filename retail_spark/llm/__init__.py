"""Operators of a training-data pipeline; nothing outside this package imports them."""

from pyspark import cloudpickle

import retail_spark

# Functions that run in Python tasks travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(retail_spark)
