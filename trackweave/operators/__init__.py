"""DataFrame -> DataFrame operators, keyed by video and frame."""
