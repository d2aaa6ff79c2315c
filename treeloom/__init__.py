"""treeloom: code-intelligence analytics expressed as Spark plans."""
