"""Column expressions: geometry, text, codes and running-time models."""
