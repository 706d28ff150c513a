"""Operators on crawl tables: seen-set, routing, scheduling, DNS and fetch outcomes, storage, statistics."""
