"""What the columns of a dataset mean: names, tags and value ranges."""
