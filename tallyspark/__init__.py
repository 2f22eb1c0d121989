"""Spark-native engine for checking the figures in financial disclosures against filed facts."""
