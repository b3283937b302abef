"""Streaming extensions of the audit log and the intake."""
