"""Spark-first engine for reasoning-data pipelines.

Every operator is a function ``DataFrame -> DataFrame`` or ``Column -> Column``.
"""

__version__ = "0.1.0"
