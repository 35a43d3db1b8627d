"""Stowage: audits large content catalogues and the references between them, on Spark."""

__version__ = "0.2.0"
