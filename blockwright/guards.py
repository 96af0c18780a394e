"""Errors of damaged or hostile input, and the limits that decoding keeps."""

from __future__ import annotations

import os

#: Most bytes of a decoded block unless BLOCKWRIGHT_MAX_BLOCK says otherwise (0: no limit).
MAX_BLOCK = 1 << 30
MAX_DICTIONARY = 1 << 20
MAX_BLOCKS = 100_000
SLACK = 64


class BlockError(Exception):
    """What can't be decoded."""


class TruncatedError(BlockError, EOFError):
    """The bytes end before the object does."""


class FormatError(BlockError, ValueError):
    """The bytes say what can't be."""


class OutputLimitError(FormatError):
    """Decoding would give more bytes than allowed."""


def max_block() -> int | None:
    limit = int(os.environ.get("BLOCKWRIGHT_MAX_BLOCK", MAX_BLOCK))
    return limit or None


def check_declared(orig_len: int) -> None:
    """Before anything of that length is made."""
    limit = max_block()
    if orig_len < 0 or limit is not None and orig_len > limit:
        raise OutputLimitError(f"a block of {orig_len} bytes is declared; the limit is {limit}")


def payload_bound(orig_len: int, expansion: int) -> int:
    """Most bytes that a block's payload may inflate to, before the inverse transform."""
    return orig_len * expansion + SLACK


def check_total(total: int, limit: int | None) -> None:
    if limit is not None and total > limit:
        raise OutputLimitError(f"{total} bytes are declared in all; the limit is {limit}")


def check_dictionary(size: int, declared: int | None = None) -> None:
    if size > MAX_DICTIONARY or declared is not None and declared > MAX_DICTIONARY:
        raise FormatError("the dictionary is over 1 MiB")
    if declared is not None and size != declared:
        raise FormatError("the dictionary's length isn't the declared one")
