"""marktext.sources."""
