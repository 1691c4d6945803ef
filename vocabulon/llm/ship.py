"""Making this package importable on executors, however the driver was started."""

from ..sources.ship import ship

__all__ = ["ship"]
