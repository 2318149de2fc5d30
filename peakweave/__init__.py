"""Spark-native analytics for tandem mass spectra: every operator takes and returns DataFrames."""
