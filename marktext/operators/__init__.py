"""marktext.operators."""
