"""sparkademia: a Spark-native engine for crawled education-programme data.

Layout
------
operators   relational and general data-processing operators
functions   column expressions and Arrow UDFs over text, URLs and numbers
sources     readers and writers
streaming   Structured Streaming operators
plans       the registered queries with their oracle SQL
llm         training-data operators (optional; nothing outside imports it)
"""

__version__ = "0.1.0"
