"""Inputs of ``create_table``: each handler says whether it takes an input and makes a DataFrame of it."""

from quarry.sources.inputs import HANDLERS, to_frame

__all__ = ["HANDLERS", "to_frame"]
