"""Files of typed text as tables."""
