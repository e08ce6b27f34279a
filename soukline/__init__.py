"""soukline: marketplace lifecycle analytics as Spark jobs."""

from soukline.sources.tables import Tables

__all__ = ["Tables"]
