"""Training-data operators over document tables."""
