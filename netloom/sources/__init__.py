"""Readers for master CSVs, feeds, timetables and geometry, and the table sinks."""
