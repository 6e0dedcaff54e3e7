"""Part of saltmarsh, a Spark-native lakehouse analytics engine."""
