"""Incremental mining: new source files as a stream."""
