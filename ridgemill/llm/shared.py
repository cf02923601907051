"""Tables written to the folder that driver and executors share (see `ridgemill.tables`)."""

from __future__ import annotations

from ridgemill.tables import discard, keep, qualified, shared_folder, unused

__all__ = ["discard", "keep", "qualified", "shared_folder", "unused"]
