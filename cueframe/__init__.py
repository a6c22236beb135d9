"""Spark-native analytics over timed text: tracks of ordered segments, as composable DataFrame operators."""
