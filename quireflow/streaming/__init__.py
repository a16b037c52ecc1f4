"""Streaming layer over event tables (an extension: the batch operators need none of it)."""
