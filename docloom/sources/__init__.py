"""Readers: files and images, slide packages, trace lines, catalogs."""
