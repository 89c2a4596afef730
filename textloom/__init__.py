"""textloom: a PySpark-native corpus-analytics engine.

Every public operator takes and returns DataFrames; planning is left to Catalyst.
"""

__version__ = "0.1.0"
