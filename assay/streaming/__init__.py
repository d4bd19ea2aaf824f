"""Streams: the batch operators' incremental forms."""
