"""Operators over messages and documents for language-model data."""
