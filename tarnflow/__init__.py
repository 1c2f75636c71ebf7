"""tarnflow: a PySpark-native engine for measurement tables and the texts they come from."""
