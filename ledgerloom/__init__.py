"""ledgerloom: a document-intelligence and retrieval-analytics engine on PySpark."""

__version__ = "0.1.0"
