"""The drain as a stream."""
