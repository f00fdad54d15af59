"""Spark-native scanning of source code and text corpora."""
