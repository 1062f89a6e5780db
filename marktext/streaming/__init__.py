"""marktext.streaming."""
