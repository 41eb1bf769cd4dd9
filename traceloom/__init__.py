"""Trace and image-stack analytics as Spark jobs.

Layout: ``sources`` reads tables, ``functions`` holds column expressions and small array kernels, ``operators`` maps
DataFrames to DataFrames, ``plans`` names the registered queries, ``streaming`` holds the incremental forms and ``llm``
the operators for training data.  Nothing outside ``llm`` imports ``llm``.
"""
