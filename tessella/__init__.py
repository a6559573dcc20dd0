"""Tessella: semantic search, similarity analysis and corpus preparation on PySpark."""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Let Python workers receive this package with the job, so that executors need no copy of it."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
