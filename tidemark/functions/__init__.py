"""Column and window helpers for ordered series."""
