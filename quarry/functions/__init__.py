"""Scalar functions whose meaning differs from Spark's: as SQL templates and as columns."""
