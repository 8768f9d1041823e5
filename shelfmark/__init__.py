"""Listing-snapshot analytics on Spark."""
