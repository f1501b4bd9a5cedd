"""Governed analytics on Spark: aggregate answers over sensitive tables, without their rows."""
