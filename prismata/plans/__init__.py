"""Plans of the engine by name."""
