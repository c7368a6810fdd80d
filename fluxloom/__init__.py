"""fluxloom: daily land-atmosphere flux analytics as lazy Spark DataFrame work."""

__version__ = "0.1.0"
