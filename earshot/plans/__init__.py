"""Named queries over stored tables, each with the SQL that computes the same rows."""
