"""Choices made before a plan is built."""
