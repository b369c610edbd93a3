"""loomstone: a Spark-native engine for compiling and auditing text knowledge at corpus scale."""
