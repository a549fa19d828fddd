"""Part of the vector clustering engine."""
