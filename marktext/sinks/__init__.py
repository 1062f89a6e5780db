"""marktext.sinks."""
