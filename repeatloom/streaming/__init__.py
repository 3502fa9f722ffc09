"""Nothing here: what this engine covers is one-shot and has no unbounded input."""
