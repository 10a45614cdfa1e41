"""spindrift: graph, event-stream and training-data analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
