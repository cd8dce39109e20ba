"""skarn: a Spark-native engine for structured documents and the graphs derived from them."""
