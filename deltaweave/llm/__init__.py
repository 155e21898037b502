"""Training-data operators: tokenising, packing, joins, search, formatting, filtering and deduplication.

Nothing outside this subpackage imports it.
"""

import ctypes
import glob
import os
import sys

# Starting the JVM forks the driver's Python, and a BLAS with threads of its own may then wait for them for ever.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
if "numpy" in sys.modules:  # the variable is too late
    import numpy

    for _path in glob.glob(os.path.join(os.path.dirname(numpy.__file__), "..", "numpy.libs", "*openblas*")):
        if _set := getattr(ctypes.CDLL(_path), "scipy_openblas_set_num_threads64_", None):
            _set(1)
