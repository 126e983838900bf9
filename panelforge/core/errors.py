"""Exceptions raised by the library."""


class LibraryError(Exception):
    """Base class."""


class InputValidationError(LibraryError, ValueError):
    """The given parameters or columns cannot be used."""


class OperationNotFoundError(LibraryError, KeyError):
    """No operation, technique or estimator has this name."""
