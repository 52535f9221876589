"""A file-catalog analytics engine on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their jobs: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .catalog import BuildOptions, Catalog, Counters  # noqa: E402
from .plans.query import Access, Field, FileSort, LocateQuery, MetaQuery, MetaSort  # noqa: E402

__all__ = ["Access", "BuildOptions", "Catalog", "Counters", "Field", "FileSort", "LocateQuery", "MetaQuery", "MetaSort"]
