"""Relational operators over the invoice model."""
