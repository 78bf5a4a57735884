"""framelake: a PySpark-native analytics engine for frame retrieval and large text corpora."""
