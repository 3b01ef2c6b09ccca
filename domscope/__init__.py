"""domscope: a Spark-native analytics engine for domain-threat intelligence."""

__version__ = "0.1.0"
