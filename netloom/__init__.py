"""Batch operators over public-transport network tables, written for Spark."""
