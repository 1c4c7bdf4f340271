"""Millrace: a PySpark-native engine for searching, analysing and preparing document collections."""
