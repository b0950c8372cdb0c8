"""Spark-native analytics over garbage-collection telemetry.

Sub-packages: ``sources`` (tables and text), ``functions`` (column helpers),
``operators`` (general data operators), ``plans`` (views, findings, registry),
``streaming`` (Structured Streaming twins).
"""
