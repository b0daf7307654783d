"""pelorus: a Spark-native engine for gridded images and source catalogues."""

__version__ = "0.1.0"
