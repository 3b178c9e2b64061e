"""Readers: tables, directory scans and document formats."""
