"""SHA-256 whose state can be handed on, so that a long file is no one task's."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from functools import lru_cache

#: Bytes of the library's SHA256_CTX: 28 words of four bytes.
STATE_BYTES = 112


@lru_cache(maxsize=1)
def _crypto():
    """OpenSSL's library, by preference the one that hashlib itself is linked with; null where its functions are not to be had."""
    import _hashlib

    for name in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        try:
            lib = ctypes.CDLL(name) if name else None
            if lib:
                lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
                lib.SHA256_Init.argtypes, lib.SHA256_Final.argtypes = [ctypes.c_char_p], [ctypes.c_char_p, ctypes.c_char_p]
                return lib
        except (OSError, AttributeError):
            continue
    return None


def begun() -> bytes:
    """The state before the first byte."""
    state = ctypes.create_string_buffer(STATE_BYTES)
    _crypto().SHA256_Init(state)
    return state.raw


def fed(state: bytes, *data: bytes) -> bytes:
    """The state after some more bytes."""
    held = ctypes.create_string_buffer(state, STATE_BYTES)
    for part in data:
        _crypto().SHA256_Update(held, part, len(part))
    return held.raw


def ended(state: bytes) -> str:
    """The digest, in hex."""
    digest = ctypes.create_string_buffer(32)
    _crypto().SHA256_Final(digest, ctypes.create_string_buffer(state, STATE_BYTES))
    return digest.raw.hex()


@lru_cache(maxsize=1)
def available() -> bool:
    """Whether this machine's library does what hashlib does, in two parts."""
    return _crypto() is not None and ended(fed(fed(begun(), b"ab" * 50), b"c")) == hashlib.sha256(b"ab" * 50 + b"c").hexdigest()
