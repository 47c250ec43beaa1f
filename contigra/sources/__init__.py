"""Readers of sequence collections, tables and reports."""
