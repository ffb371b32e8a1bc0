"""Synthetic data on Spark: generate, profile, validate, compare, shape and export tables."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from plumbline.plans.spec import ColumnSpec, DatasetSpec, Distribution  # noqa: E402
from plumbline.plans.generate import compile_spec, generate  # noqa: E402

__all__ = ["ColumnSpec", "DatasetSpec", "Distribution", "compile_spec", "generate"]
