"""PySpark-native retrieval, graph, ledger and text analytics."""
