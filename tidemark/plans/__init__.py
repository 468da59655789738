"""Views over the tables and the named queries."""
