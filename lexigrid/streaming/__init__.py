"""Scoring of arriving text."""
