"""Readers and writers of the tables' file formats."""
