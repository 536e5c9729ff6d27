"""gale.operators."""
