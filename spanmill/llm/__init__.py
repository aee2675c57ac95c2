"""Operators of a training-data pipeline. Nothing else in spanmill imports this subpackage."""
