"""Readers and writers for prompt, result and batch files."""
