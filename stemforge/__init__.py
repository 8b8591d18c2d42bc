"""stemforge: a PySpark-native engine that turns document text and model output into question records."""
