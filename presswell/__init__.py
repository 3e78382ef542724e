"""presswell: analytics over institutional news as DataFrame transformations."""

__version__ = "0.1.0"
