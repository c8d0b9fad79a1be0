"""Registered query plans of the engine's operators and their SQL twins."""
