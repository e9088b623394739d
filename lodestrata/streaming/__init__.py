"""Streams: windows over events, keyed state, change logs."""
