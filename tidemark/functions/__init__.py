"""Column functions and scale-safe building blocks."""
