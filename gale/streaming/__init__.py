"""gale.streaming."""
