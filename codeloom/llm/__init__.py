"""Operators on texts for training data. Nothing outside imports this subpackage."""
