"""Rate windows, in batch and as a stateful stream."""
