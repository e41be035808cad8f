"""Operators of a training-data pipeline; nothing else in tiermark imports this package."""
