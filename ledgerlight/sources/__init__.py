"""Readers and writers of catalogs, sessions, traces and corpora."""
