"""A Spark-native analytics engine for machine-transcribed historical documents."""
