"""marktext.functions."""
