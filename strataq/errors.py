"""Errors of the store."""


class StoreError(Exception):
    """Any error of the store."""


class DatabaseNotFoundError(StoreError):
    pass


class DatabaseAlreadyExistsError(StoreError):
    pass


class DatabaseNotEmptyError(StoreError):
    pass


class TableNotFoundError(StoreError):
    pass


class TableAlreadyExistsError(StoreError):
    pass


class EmptyKeyError(StoreError, ValueError):
    pass


class EmptyValueError(StoreError, ValueError):
    pass


class NoOrderError(StoreError, ValueError):
    pass
