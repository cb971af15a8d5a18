"""Readers and writers of files, feeds, sitemaps and catalog documents."""
