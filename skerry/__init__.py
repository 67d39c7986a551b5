"""skerry: a PySpark-native analytics engine.

Sub-packages: ``sources`` (readers, sinks, snapshot tables), ``operators`` (relational and dataflow operators),
``functions`` (scalar and aggregate expressions), ``plans`` (DataFrame-level rewrites and the plan report) and
``streaming`` (event-time helpers).
"""

from skerry.session import build_session

__all__ = ["build_session"]
