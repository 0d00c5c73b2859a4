"""Relational operators over evidence graphs, text, annotations and audits."""
