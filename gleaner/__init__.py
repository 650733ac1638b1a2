"""Content-ingestion analytics on Spark: crawled documents in, curated tables out."""
