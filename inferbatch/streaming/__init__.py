"""Structured Streaming versions of the operators that follow a running system."""
