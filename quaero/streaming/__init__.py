"""Additional to the batch operators: the same plans over streams."""
