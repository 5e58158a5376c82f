"""Readers of raw network files and relational tables, and stores."""
