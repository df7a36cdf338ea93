"""Operators of a training-data pipeline: sharding, filters, scans, deduplication, packing, WARC and HTML."""
