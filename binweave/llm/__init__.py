"""Operators for preparing text for training. Nothing outside this subpackage imports it."""
