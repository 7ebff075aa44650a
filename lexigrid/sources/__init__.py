"""Readers of labelled text and the experiment registry."""
