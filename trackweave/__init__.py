"""Motion-track analytics as lazily composed PySpark DataFrame operators."""
