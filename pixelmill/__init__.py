"""pixelmill: a PySpark-native raster analytics engine (see README.md)."""

__version__ = "0.1.0"
