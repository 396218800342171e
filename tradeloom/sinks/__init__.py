"""What leaves the engine."""
