"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the workers by value, so executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
