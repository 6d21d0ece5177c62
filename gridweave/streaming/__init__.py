"""A cube reads a snapshot of its facts, so there is nothing here to stream; a new snapshot is a new cube."""
