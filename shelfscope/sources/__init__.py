"""Readers, the workspace of logs and dimensions, and writers."""
