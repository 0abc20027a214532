"""Named queries over the tables, each with its SQL."""
