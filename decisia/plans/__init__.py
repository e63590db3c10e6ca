"""Whole flows: the mix pipeline, and the catalog of queries with the SQL that checks them."""
