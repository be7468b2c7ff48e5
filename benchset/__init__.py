"""Registered queries over the supplied tables, with the SQL each is checked against."""
