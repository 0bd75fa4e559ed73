"""Readers, literal tables, calendars and sinks."""
