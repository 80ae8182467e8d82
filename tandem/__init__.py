"""Tandem: pairs-trading analytics written as Spark DataFrame jobs."""
