"""gale.plans."""
