"""Scans and sinks (files, tables, streams)."""
