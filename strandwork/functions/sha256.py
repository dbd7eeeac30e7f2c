"""SHA-256 that can be left in one task and gone on with in another."""

from __future__ import annotations

import ctypes
import functools
import _hashlib

#: ``SHA256_CTX`` of OpenSSL: eight words, a bit count of two, a block of sixteen, two lengths.
STATE = 112


@functools.cache
def _library() -> ctypes.CDLL:
    """The OpenSSL that Python's own digests use."""
    return ctypes.CDLL(_hashlib.__file__)


class resumed:
    """A digest begun anew, or gone on with from the ``state`` of an earlier one."""

    def __init__(self, state: bytes | None = None):
        self._own = ctypes.create_string_buffer(state or b"", STATE)
        if state is None:
            _library().SHA256_Init(self._own)

    def update(self, data: bytes) -> None:
        _library().SHA256_Update(self._own, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._own.raw

    def hexdigest(self) -> str:
        out, end = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._own.raw, STATE)
        _library().SHA256_Final(out, end)
        return out.raw.hex()
