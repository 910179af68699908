"""Errors of the engine: one base, and a category for each thing that can be wrong with a dataset."""


class AnnotatedMatrixError(Exception):
    """Base of all errors raised by the engine."""


class NotFoundError(AnnotatedMatrixError):
    """A path, slot or field that isn't there."""


class CommandError(AnnotatedMatrixError):
    """A command that failed; ``stderr`` holds what it wrote."""

    def __init__(self, command: str, stderr: str = ""):
        super().__init__(f"{command}: {stderr}" if stderr else command)
        self.command, self.stderr = command, stderr


class InvalidFormatError(AnnotatedMatrixError):
    """Data that isn't laid out as its format says."""


class UnsupportedVersionError(InvalidFormatError):
    """A format version that can't be read."""


class DtypeMismatchError(InvalidFormatError):
    """Stored values of another type than declared."""


class MissingFieldError(NotFoundError, InvalidFormatError):
    """A field that the format needs."""
