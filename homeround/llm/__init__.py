"""Operators that a pipeline for training data needs. Nothing outside this subpackage imports it."""
