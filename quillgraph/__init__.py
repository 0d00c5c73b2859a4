"""PySpark-native analytics over evidence graphs and text corpora."""
