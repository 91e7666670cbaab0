"""Operators for preparing training text at scale (own subpackage; nothing else imports it).

Functions of this package travel to Python workers by value, so executors need the libraries
but not this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
