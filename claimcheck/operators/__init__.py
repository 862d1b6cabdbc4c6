"""DataFrame in, DataFrame out: the operators of the verification run."""
