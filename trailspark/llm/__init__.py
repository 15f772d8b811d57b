"""Operators of a training-data pipeline; nothing else in the package imports this folder.

Functions that run in tasks are shipped with the job, so that workers need no copy of the
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
