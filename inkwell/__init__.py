"""Corpus n-gram, PMI and word-discovery engine on Spark."""
