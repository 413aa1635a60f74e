"""Operators for training-data pipelines. Nothing else in papyrine imports this subpackage."""
