"""vecmill: multi-vector retrieval analytics and training-data operators on Spark."""
