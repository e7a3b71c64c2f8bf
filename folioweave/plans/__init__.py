"""Named queries over the fixture tables, and their SQL twins."""
