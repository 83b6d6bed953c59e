"""gridloom: a Spark-native engine for points in space, ordered frames and text corpora."""
__version__ = "0.1.0"
