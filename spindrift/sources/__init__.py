"""Readers and writers beyond those that Spark has."""
