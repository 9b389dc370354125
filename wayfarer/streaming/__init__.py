"""Structured Streaming operators; ``inputs`` has them, each with a batch form."""
