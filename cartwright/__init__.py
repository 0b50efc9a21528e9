"""Customer-order analytics as Spark jobs: marts, features, training, monitoring, decisions, streams."""
