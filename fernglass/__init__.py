"""fernglass: a PySpark-native engine for append-only content archives.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame
operators), ``sources`` (readers, parsers and sinks), ``plans`` (named queries with their SQL
oracles), ``streaming`` (Structured Streaming twins) and the optional ``llm`` (operators for
training data; nothing else imports it).
"""

__version__ = "0.1.0"
