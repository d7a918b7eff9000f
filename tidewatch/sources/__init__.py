"""Readers and writers of the event log and of rules."""
