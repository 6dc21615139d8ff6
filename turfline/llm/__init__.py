"""Operators for preparing text, page and vector corpora.

Nothing outside this folder imports it.  Functions that run inside Spark tasks are shipped by value, so that executors
need no installed copy.
"""

import sys

from pyspark import cloudpickle


def by_value(module_name: str) -> None:
    """Ship the functions of a module with the job instead of importing them on the executors."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)
