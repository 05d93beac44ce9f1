"""Errors raised before a plan is built, or by readers."""


class NodelakeError(Exception):
    """Base of all of them."""


class NotFound(NodelakeError):
    """A path, key, document or file that is not there."""


class Validation(NodelakeError):
    """A request that makes no sense for the node it names."""


class InvalidSlice(NodelakeError):
    """A slice that cannot be parsed or does not fit the array."""


class InvalidDType(NodelakeError):
    """A data type string or document that is not one."""


class Unsupported(NodelakeError):
    """A format whose library is not installed, or a type without an equivalent."""
