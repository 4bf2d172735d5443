"""Errors. Data and configuration problems stop a run; nothing is repaired in silence."""


class IntegrityError(RuntimeError):
    """Data break a rule of the engine."""


class ConfigError(ValueError):
    """A configuration is not valid."""
