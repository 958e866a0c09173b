"""gridloom: curation and analysis of spatial vision data on Spark DataFrames.

Functions that run inside Python workers travel to the executors by value, so the
package needs to be installed on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
