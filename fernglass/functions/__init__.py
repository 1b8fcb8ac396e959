"""Column functions: URLs, texts, digests, dates and politeness arithmetic."""
