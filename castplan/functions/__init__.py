"""Column helpers: every function takes and returns ``pyspark.sql.Column`` (JVM side)."""

from castplan.functions.clean import *  # noqa: F401,F403
from castplan.functions.dates import *  # noqa: F401,F403
from castplan.functions.status import *  # noqa: F401,F403
