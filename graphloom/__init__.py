"""graphloom: a PySpark-native engine for diagram benchmark data.

Layout: ``functions`` (column expressions), ``sources`` (readers and writers),
``operators`` (DataFrame to DataFrame), ``plans`` (the query catalogue with its
SQL), ``streaming`` (Structured Streaming ingestion) and ``llm`` (training-data
operators; nothing outside that subpackage imports it).
"""
