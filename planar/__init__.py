"""planar: Spark-native analytics over planar geometry and positioned text."""
