"""Tessera: Spark-native operators for text corpora, property graphs and concept vectors."""
