"""Errors of the library. Each is a ValueError too, so callers may catch that alone."""


class PatternError(ValueError):
    """Anything the library refuses."""


class EmptyDataError(PatternError):
    """There is no row to work on."""


class InsufficientDataError(PatternError):
    def __init__(self, needed: int, got: int):
        super().__init__(f"needs {needed} values, got {got}")
        self.needed, self.got = needed, got


class ConfigError(PatternError):
    def __init__(self, key: str, message: str):
        super().__init__(f"{key}: {message}")
        self.key = key


class SingularDataError(PatternError):
    """A matrix that has no inverse."""
