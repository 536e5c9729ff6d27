"""gale.functions."""
