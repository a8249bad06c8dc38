"""corpusloom: a PySpark-native engine for analysing bodies of text and source code as connected data."""
