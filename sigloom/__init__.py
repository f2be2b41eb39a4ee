"""Spark jobs for multichannel signal sessions and for training-data corpora."""
