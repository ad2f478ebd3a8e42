"""Training-data operators: ten independent components, imported by nothing else in the library."""
