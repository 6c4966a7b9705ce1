"""Drawing-quantity analytics and training-data operators on Spark."""
