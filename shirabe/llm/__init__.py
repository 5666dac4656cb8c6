"""Training-data operators: extraction, language, tokens, secrets, sharding, search, near copies."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so executors need no copy of this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
