"""Spark-native text-quality analytics: rules, spans, structure, scores, gates and safe edits over corpora."""

__version__ = "0.1.0"
