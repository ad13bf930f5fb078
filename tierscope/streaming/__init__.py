"""Directory streams of requests."""
