"""Folder discovery, mail-folder scans and result sinks."""
