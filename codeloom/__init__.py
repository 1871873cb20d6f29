"""codeloom: a PySpark-native engine for code graphs, search and text analytics."""
