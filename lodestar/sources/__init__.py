"""Readers of payloads and documents."""
