"""Readers and writers of traces, reports and dimensions."""
