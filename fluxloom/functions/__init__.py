"""Column expressions: guards, physics, hybrid models, labels and statistics."""
