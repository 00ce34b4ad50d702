"""The annotation log as a stream."""
