"""Entity resolution here is a batch job; nothing in it needs a stream."""
