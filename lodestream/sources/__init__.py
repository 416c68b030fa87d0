"""Readers, logical views over the driver tables, and writers."""
