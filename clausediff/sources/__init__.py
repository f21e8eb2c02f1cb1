"""Documents in, reports out."""
