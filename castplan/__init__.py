"""castplan: make-to-order production demand and capacity analytics on Spark DataFrames.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``; nothing is collected
to the driver except one-row validation results.  Sub-packages:

* ``functions``  Column helpers (cleaning, dates, status bands, labels)
* ``sources``    readers, the ERP-shaped adapter over the driver tables, history sinks
* ``operators``  open-order assembly, quality audits, compatibility, eligibility,
                 priority, calendar, capacity allocation
* ``plans``      report plans built from the operators, and the end-to-end schedule
* ``streaming``  incremental snapshot ingestion with Structured Streaming
"""

__version__ = "0.1.0"

# Functions that run inside Python workers (the allocator's grouped map) are shipped by value,
# so executors do not need this package installed or on their path.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
