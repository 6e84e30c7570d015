"""leadframe: Spark-native analytics over component datasheets."""
