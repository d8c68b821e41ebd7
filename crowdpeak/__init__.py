"""crowdpeak: find the moments of long recordings that made viewers react, as Spark DataFrame operators."""

from crowdpeak.settings import Settings

__all__ = ["Settings"]
