"""claimgraph: a Spark-native engine for reviewed, bi-temporal knowledge graphs."""
