"""Errors of the engine."""


class ParsingException(Exception):
    """The SQL text can't be read, or Spark's analysis rejects it."""


class OptimizationException(Exception):
    """A plan can't be optimised."""
