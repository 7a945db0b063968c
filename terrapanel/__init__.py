"""terrapanel: place-and-period panel analytics expressed as Spark DataFrame functions."""

__version__ = "0.1.0"
