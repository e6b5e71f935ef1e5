"""pairloom: co-occurrence analytics for labelled intervals on Spark."""

__version__ = "0.1.0"
