"""Statistical analytics on Spark DataFrames: profile, clean, mask, test, regress, chart data.

Every operator takes a DataFrame and returns a DataFrame (usually a small tidy
table).  Rows stay on the executors; only bounded scalars - counts, means,
quartiles, a p x p Gram matrix - ever reach the driver.
"""

import sys

from pyspark import cloudpickle

# Python tasks carry the library functions by value, so executors need no
# separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
