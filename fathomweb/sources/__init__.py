"""Seeds, bookmarks, synthetic URLs, responses."""
