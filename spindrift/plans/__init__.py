"""Compositions: whole pipelines from tables to results."""
