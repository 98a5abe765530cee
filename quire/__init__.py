"""quire: a Spark-native engine for collections of paginated, multilingual documents."""

__version__ = "0.1.0"
