"""docsieve: document-bucket analytics expressed as PySpark DataFrame transformations."""

import sys

from pyspark import cloudpickle

from docsieve.session import tuned_session

# user functions travel to the Python workers by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["tuned_session"]
