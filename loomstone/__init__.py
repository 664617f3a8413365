"""Code-intelligence analytics and training-data operators as Spark DataFrame functions."""
