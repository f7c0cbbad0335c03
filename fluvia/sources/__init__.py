"""Readers and writers of what the engine exchanges with others."""
