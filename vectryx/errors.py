"""Errors that callers tell apart; `status` is what the HTTP layer answers with."""


class VectorError(Exception):
    status = 500


class InvalidRequest(VectorError, ValueError):
    status = 400


class DimensionMismatch(InvalidRequest):
    pass


class HybridNotEnabled(InvalidRequest):
    def __init__(self, name: str):
        super().__init__(f"collection {name!r} has no text field: hybrid search not enabled")


class CollectionExists(InvalidRequest):
    def __init__(self, name: str):
        super().__init__(f"collection {name!r} already exists")


class CollectionNotFound(VectorError, KeyError):
    status = 404

    def __init__(self, name: str):
        super().__init__(f"collection {name!r} not found")

    def __str__(self) -> str:
        return self.args[0]


class DuplicateId(VectorError):
    status = 409

    def __init__(self, ids: list[str]):
        super().__init__(f"ids already present: {', '.join(map(repr, ids))}")
        self.ids = ids
