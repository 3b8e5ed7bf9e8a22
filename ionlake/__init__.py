"""Spark-native processing of spectra and of text corpora."""
