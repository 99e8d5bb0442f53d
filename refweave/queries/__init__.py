"""Queries over the star-schema tables, a few for each family of operators, with the SQL that each is checked against."""
