"""SHA-256 whose state can be kept and gone on with in another task: OpenSSL's, which Python loads for ``hashlib`` but does not let out."""

from __future__ import annotations

import ctypes
import hashlib
import struct
from functools import cache


class _Context(ctypes.Structure):
    """SHA256_CTX of OpenSSL: plain numbers, no pointers."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


@cache
def _library() -> ctypes.CDLL | None:
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        for f, kinds in ((lib.SHA256_Init, [ctypes.c_void_p]), (lib.SHA256_Update, [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]), (lib.SHA256_Final, [ctypes.c_char_p, ctypes.c_void_p])):
            f.argtypes = kinds
        return lib
    except (ImportError, OSError, AttributeError):
        return None


class Sha256:
    """``count`` bytes are in. Without OpenSSL's functions it is ``hashlib``'s, and the state is only the bytes' number, or all of a few first bytes."""

    def __init__(self, state: bytes | None = None):
        self.count, self.lib = 0, _library()
        if self.lib is None:
            self.plain, self.first = hashlib.sha256(), b""
            if state:
                self.update(state)
            return
        self.context = _Context()
        self.lib.SHA256_Init(ctypes.byref(self.context))
        if state is not None:
            (self.count,) = struct.unpack_from("<q", state)
            self.context = _Context.from_buffer_copy(state, 8)

    def update(self, data: bytes) -> None:
        self.count += len(data)
        if self.lib is None:
            self.plain.update(data)
            self.first = (self.first + data[:8])[:8]
        else:
            self.lib.SHA256_Update(ctypes.byref(self.context), data, len(data))

    def state(self) -> bytes:
        if self.lib is None:
            return self.first if self.count <= 8 else b""
        return struct.pack("<q", self.count) + bytes(self.context)

    def hexdigest(self) -> str:
        if self.lib is None:
            return self.plain.hexdigest()
        copy, out = _Context.from_buffer_copy(self.context), ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.byref(copy))
        return out.raw.hex()


def after(data: bytes) -> bytes:
    """The state after a few first bytes."""
    digest = Sha256()
    digest.update(data)
    return digest.state()


def resumable() -> bool:
    """Whether a state can be gone on with here, tried out against ``hashlib``."""
    if _library() is None:
        return False
    data = bytes(range(256)) * 3
    digest = Sha256(after(data[:333]))
    digest.update(data[333:])
    return digest.hexdigest() == hashlib.sha256(data).hexdigest()
