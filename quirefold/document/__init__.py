"""Documents in memory: what the operators do to one file inside an Arrow batch."""
