"""Training-data pipeline operators; nothing else in ``docgraph`` imports this package."""
