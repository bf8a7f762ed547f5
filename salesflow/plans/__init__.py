"""Named analytics. Each takes the sales DataFrame and returns a DataFrame."""
