"""DataFrame-in, DataFrame-out statistical operators."""
