"""Extension beyond the batch suite: windows over a stream of events."""
