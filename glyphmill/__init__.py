"""glyphmill: analytics of machine-text detection, and preparation of training text, on Spark."""
