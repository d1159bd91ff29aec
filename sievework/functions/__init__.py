"""Column expressions: text, masking, chunking, entities, classes, signals, hashes."""
