"""leafmark: locating structural page ranges in paginated documents with Spark.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column functions),
``operators`` (DataFrame -> DataFrame), ``plans`` (composed queries) and
``streaming`` (Structured Streaming forms).
"""
