"""Corpus analytics as DataFrame operations."""
