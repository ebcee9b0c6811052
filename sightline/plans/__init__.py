"""Registered queries over the derived scene, and the same in SQL."""
