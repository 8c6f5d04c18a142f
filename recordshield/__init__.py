"""recordshield: keep, de-identify and check large sets of personal records on Spark."""

__version__ = "0.1.0"
