"""keytide: keyed table copy, change capture and reconciliation on Spark DataFrames."""

__version__ = "0.1.0"
