"""Operators on tables of text units; each unit has its document and its position, never an implied row order."""
