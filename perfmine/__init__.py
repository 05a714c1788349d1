"""Spark-native mining, measurement and evaluation of performance changes.

Sub-packages:

* ``functions``  column expressions and small reusable DataFrame algorithms
* ``sources``    readers and writers with fixed schemas
* ``operators``  joins, filters and aggregations of one concern each
* ``plans``      end-to-end jobs composed from operators
* ``streaming``  the Structured Streaming forms
* ``queries``    the registered queries over the driver tables
"""
