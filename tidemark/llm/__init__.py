"""Operators over texts and numeric columns for training data; nothing outside this folder imports it."""
