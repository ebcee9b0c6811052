"""Micro-batch forms: a frame is judged on its own, so batches of whole frames need no state."""
