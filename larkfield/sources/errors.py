"""Typed errors of data vendors; only these let a chain move on to its next vendor."""


class VendorError(RuntimeError):
    pass


class NoDataError(VendorError):
    pass


class RateLimitError(VendorError):
    pass


class NotConfiguredError(VendorError):
    pass
