"""Errors of the engine. Shapes that can't be answered right are refused when the plan is built."""


class DocframeError(Exception):
    """Base of all errors."""


class NotSupported(DocframeError):
    """The query has a shape that is refused by design."""


class InvalidOperation(DocframeError):
    """The operation doesn't fit the state of its input."""


class CardinalityError(InvalidOperation):
    """No element, or more than one, where exactly one was asked for."""


class CastError(DocframeError):
    """A document isn't of the asked type."""


class RangeError(DocframeError):
    """A position outside its sequence."""


class KeyNotFound(DocframeError):
    """No document has the key."""


class UniqueViolation(DocframeError):
    """Two documents share a key that has to be unique."""


class PolicyViolation(DocframeError):
    """A delete policy forbids the operation."""


class VersionConflict(DocframeError):
    """The document changed since it was read."""


class WriteConflict(DocframeError):
    """Another writer committed a change to the same table since this one began."""


class Aborted(DocframeError):
    """A handler refused the change; nothing was written."""
