"""Readers and writers: sitemaps, feeds, JSON payloads, page trees, link lists, notes."""
