"""Feature engineering and risk scoring for payment tables, as Spark DataFrame operators."""

__version__ = "0.1.0"
