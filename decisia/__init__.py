"""Decisia: a PySpark-native engine for preparing, auditing and scoring typed-decision data."""
