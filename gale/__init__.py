"""gale: rare-event forecast building and verification on Spark DataFrames.

Subpackages: ``sources`` (readers/writers), ``functions`` (column helpers),
``operators`` (DataFrame -> DataFrame jobs), ``plans`` (stand-in views and
the query catalog), ``streaming`` (file-stream jobs).
"""

__version__ = "0.1.0"
