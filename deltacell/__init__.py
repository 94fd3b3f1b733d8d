"""deltacell: change detection between two dates on gridded data, as Spark DataFrame jobs."""

__version__ = "0.1.0"
