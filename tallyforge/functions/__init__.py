"""Package of the engine."""
