"""Incremental processing: schedules and file streams."""
