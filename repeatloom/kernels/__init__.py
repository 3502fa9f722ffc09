"""Sequential sequence kernels: plain Python and numpy, tested without Spark."""
