"""A Spark-native engine for internationalization metadata in tree-shaped documents."""
