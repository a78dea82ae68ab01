"""A PySpark-native engine for geospatial features, area ranking and training-data pipelines."""
