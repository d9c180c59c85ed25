"""texloom: Spark-native cataloguing, checking and derivation of texture assets."""

__version__ = "0.1.0"
