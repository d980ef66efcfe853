"""Statement analytics on Spark: bank and card exports in, a deduplicated ledger and its questions out."""

__version__ = "0.1.0"
