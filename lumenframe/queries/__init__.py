"""Named queries over the tables, one module for each part of the API, each with the SQL it is held against."""
