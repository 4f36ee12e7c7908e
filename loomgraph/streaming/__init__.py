"""The event queue as a stream."""
