"""Flows composed of operators."""
