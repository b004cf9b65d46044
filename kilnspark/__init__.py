"""kilnspark: a Spark-native analytics engine for corpora of source files and text."""
