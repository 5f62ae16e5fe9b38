"""DataFrame operators, one module per stage of a batch job's life."""
