"""lakeloom: Spark-native document and event ETL analytics.

Subpackages: ``sources`` (readers), ``operators`` (DataFrame operators),
``functions`` (column helpers, inference, UDFs), ``sinks`` (writers),
``streaming`` (Structured Streaming jobs) and ``plans`` (registered queries,
SQL surface, pattern jobs).
"""

__version__ = "0.1.0"
