"""lumiframe: Spark-native analytics over ordered frame rows (video -> frame -> face)."""
