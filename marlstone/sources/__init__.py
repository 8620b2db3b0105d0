"""Catalogs, readers, loaders and writers."""
