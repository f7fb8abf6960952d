"""Growth, retention, revenue and funnel metrics as Spark DataFrame functions.

Every metric is a function of a :class:`~tidemark.model.Model` (users, activity,
subscription) that returns a DataFrame; Catalyst and AQE plan the work.
"""

from tidemark.model import Model, Rules

__all__ = ["Model", "Rules"]
