"""Errors of the pipeline."""


class HashloomError(Exception):
    """Base of all errors here."""


class AlreadyRunning(HashloomError):
    """A run was started while another of the same engine is going on."""


class InvalidSetting(HashloomError, ValueError):
    """A part of an engine that can't be one."""


class InvalidName(HashloomError, ValueError):
    """A user's name that would lead out of the upload folder."""


class PathNotFound(HashloomError):
    """The images' folder doesn't exist."""


class UndecodableImage(HashloomError):
    """A file that is no image: a strict run ends with it, any other records it and goes on."""


class ModificationNotFound(HashloomError):
    """No registered modification has that position or name."""


class HashingMethodNotFound(HashloomError):
    """No registered hashing method has that position or name."""


class NotEnoughHashes(HashloomError):
    """A method with fewer than two hashes can't be matched."""

    def __init__(self, method_id: int, found: int):
        super().__init__(f"method {method_id}: {found} hashes, matching needs 2 or more")
        self.method_id, self.found = method_id, found


class HashesNotEqualLength(HashloomError):
    """Two hashes of one method differ in length: a strict run ends with it, any other leaves their pairs out."""

    def __init__(self, first: int, second: int):
        super().__init__(f"hashes of {first} and {second} bits")
        self.first, self.second = first, second


class StoreError(HashloomError):
    """A table of the store can't be read or written."""


class NoRun(HashloomError):
    """The store has no run to be active."""
