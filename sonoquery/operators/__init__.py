"""DataFrame operators: scoring by bands and bins, rooms, sampling, scenes, labels."""
