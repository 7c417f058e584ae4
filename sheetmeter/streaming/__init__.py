"""Drawings as they arrive in a folder."""
