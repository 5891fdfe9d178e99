"""Operators for training text: packing, evaluation leaks and shared spans."""
