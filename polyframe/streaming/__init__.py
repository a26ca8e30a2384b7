"""Structured Streaming versions of the time-window operators."""

from .windows import read_folder, run_once, sessions, sliding, tumbling

__all__ = ["read_folder", "run_once", "sessions", "sliding", "tumbling"]
