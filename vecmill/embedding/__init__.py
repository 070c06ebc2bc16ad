"""embedding of the engine."""
