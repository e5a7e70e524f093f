"""Training-data operators: ten corpus components that stand apart from the rest of the library."""
