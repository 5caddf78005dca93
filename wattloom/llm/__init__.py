"""Operators of a training-data pipeline: documents in, decisions and files out. Nothing else in the library imports this folder."""
