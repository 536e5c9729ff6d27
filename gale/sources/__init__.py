"""gale.sources."""
