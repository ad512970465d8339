"""Readers and writers for tables, nested JSON and web pages."""
