"""Errors that callers can tell apart."""


class QueryError(ValueError):
    """A document, pattern or option that is not valid."""


class LimitExceeded(RuntimeError):
    """A resource limit was reached and the caller asked to fail."""


class GuardViolation(RuntimeError):
    """An edit guard refused, or a reference is stale."""
