"""marktext.plans."""
