"""Readers, writers and driver-table views."""
