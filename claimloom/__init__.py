"""Spark-native claim and risk analytics.

``operators``, ``sources``, ``functions``, ``plans`` and ``streaming`` hold the
analytics engine; ``llm`` holds the training-data operators and is imported by
nothing else in the library.
"""
