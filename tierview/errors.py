"""Failures, each with the exit code of the command line."""


class TierviewError(Exception):
    exit_code = 1


class ContractError(TierviewError):
    """The contract, or the command line, is invalid."""

    exit_code = 2


class InputError(TierviewError):
    """The source events are malformed."""

    exit_code = 3


class CorruptArchive(TierviewError):
    """An archive's files, layout or invariants are broken, or it can't be read at all."""

    exit_code = 4


class QueryRejected(TierviewError):
    """The request is outside what the contract preserves."""

    exit_code = 5


class VerificationMismatch(TierviewError):
    """Views and source disagree."""

    exit_code = 6


class BenchmarkError(TierviewError):
    """A benchmark or its data is unusable."""

    exit_code = 7
