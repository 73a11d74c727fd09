"""sieveline: security-log analytics as Spark DataFrame jobs.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` built
from native Spark expressions; see README.md for the module map.
"""

from sieveline.session import configure, get_session

__all__ = ["configure", "get_session"]
