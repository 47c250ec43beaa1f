"""Queries over whole tables, and the views they stand on."""
