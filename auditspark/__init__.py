"""auditspark: a Spark-native source-audit and corpus-preparation engine."""
