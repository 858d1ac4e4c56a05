"""DataFrame operators of the file catalogue."""
