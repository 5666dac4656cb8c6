"""Scalar functions."""

from pyspark import cloudpickle

from shirabe.functions import jsonx, text

# Ship the few Python helpers with the tasks: executors need not have the package.
cloudpickle.register_pickle_by_value(jsonx)
cloudpickle.register_pickle_by_value(text)
