"""Errors that carry a stable code."""


class CodedError(Exception):
    """A refused request; ``code`` is part of the interface."""

    def __init__(self, code: str, **detail):
        super().__init__(code)
        self.code, self.detail = code, detail
