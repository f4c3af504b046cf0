"""Readers and writers of the file formats that sequence panels come in."""
