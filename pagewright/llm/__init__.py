"""Operators on free text for training data; nothing outside this subpackage imports it."""
