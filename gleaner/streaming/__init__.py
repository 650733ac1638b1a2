"""Structured Streaming forms of discovery, ledger state, run metrics and chapter marks."""
