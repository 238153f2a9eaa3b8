"""Retrieval plans and the query catalogue."""
