"""chronoframe: point-in-time panel analytics as Catalyst plans."""

__version__ = "0.1.0"
