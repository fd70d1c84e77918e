"""Operators for training-corpus pipelines; nothing outside this subpackage imports it."""
