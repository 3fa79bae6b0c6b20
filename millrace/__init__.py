"""millrace: corpus preparation and evaluation analytics as Spark query plans."""

__version__ = "0.1.0"
