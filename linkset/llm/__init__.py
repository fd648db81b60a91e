"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this package. ``queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five
of them. Functions that run inside Python tasks travel by value, so that
executors need numpy, pyarrow and the like, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
