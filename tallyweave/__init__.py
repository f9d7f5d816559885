"""Payment-graph risk analytics and training-data preparation on Apache Spark."""
