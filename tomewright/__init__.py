"""Spark-native preparation of long texts: clean, section, gate, chunk and time chapters as DataFrames."""
