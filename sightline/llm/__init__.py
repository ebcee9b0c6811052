"""Training-data operators: ten corpus operations over plain Spark tables."""
