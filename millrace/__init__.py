"""millrace: Spark-native operators for relational statistics, mining, graphs, sketches and streams."""
