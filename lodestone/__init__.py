"""lodestone: a PySpark-native analytics engine for collections of atomic structures."""

__version__ = "0.1.0"
