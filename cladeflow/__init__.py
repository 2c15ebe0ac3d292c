"""Comparative genomics on Spark: k-mer screens, gene families, distances, trees and tests.

Everything is a function from DataFrames to DataFrames; nothing here starts a session.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel inside the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
