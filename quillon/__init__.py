"""quillon: a PySpark-native analytics engine for availability signals in creator profiles."""
