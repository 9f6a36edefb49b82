"""Composed plans: the registered queries over the driver's tables."""
