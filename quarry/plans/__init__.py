"""Statements, plan inspection, diagnostics and the query catalogue."""
