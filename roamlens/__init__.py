"""Review analytics expressed as Spark jobs.

Every operator is a function from DataFrames to a DataFrame. ``sources`` reads and
writes tables, ``functions`` holds column expressions, ``operators`` the table jobs,
``streaming`` the Structured Streaming jobs and ``plans`` the registered queries.
"""
