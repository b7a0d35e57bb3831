"""lexaudit: a PySpark-native engine that audits tables of documents."""
