"""triplewright: a Spark-native analytics engine for triples, property graphs and text corpora."""

__version__ = "0.1.0"
