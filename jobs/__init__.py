"""Runnable jobs: python -m jobs.graph_dataset | jobs.goal_log, each with a small JSON config."""
