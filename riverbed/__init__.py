"""Spark operators for ordered event traces and conversational corpora."""
