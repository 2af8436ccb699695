"""vidsift: Spark-native operators for video event retrieval and corpus analytics."""
