"""Exceptions of the catalog, ingest and key-value layers."""


class SaltmarshError(Exception):
    """Base of all of them."""


class InvalidArgument(SaltmarshError, ValueError):
    pass


class TableNotFound(SaltmarshError, LookupError):
    pass


class TableExists(SaltmarshError):
    pass


class SnapshotNotFound(SaltmarshError, LookupError):
    pass


class KeyNotFound(SaltmarshError, LookupError):
    pass


class SchemaMismatch(SaltmarshError, ValueError):
    pass


class NotNullViolation(SaltmarshError, ValueError):
    pass


class CommitConflict(SaltmarshError):
    pass


class Unsupported(SaltmarshError, NotImplementedError):
    pass
