"""The point-in-time features kept up to date by a stream."""
