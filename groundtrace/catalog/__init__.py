"""Registered queries over the shared test tables, with the SQL that states the same result."""
