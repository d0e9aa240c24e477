"""SHA-256 of files too large for one task: a task reads one piece of a file and hands the digest's state on to the next piece's task.

A digest is one chain over all bytes, so a file's pieces follow each other; the pieces of different files are read at the same time.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import os

from pyspark import SparkContext

#: Bytes a task holds at once.
_BLOCK_BYTES = 4 << 20


class _Context(ctypes.Structure):
    """OpenSSL's SHA256_CTX: hashlib's objects cannot be taken to another process, this one's bytes can."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16),
        ("num", ctypes.c_uint), ("md_len", ctypes.c_uint),
    ]


@functools.cache
def _crypto() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib uses, or the system's."""
    import _hashlib

    for place in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        if place and hasattr(library := ctypes.CDLL(place), "SHA256_Update"):
            library.SHA256_Init.argtypes = [ctypes.c_void_p]
            library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            library.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
            return library
    return None


def can_resume() -> bool:
    return _crypto() is not None


def _advanced(item: tuple, piece: int) -> tuple:
    """(key, file, size, bytes done, state, stamp), one piece further; the state of a whole file is its digest in hexadecimal."""
    key, file, size, done, state, stamp = item
    crypto = _crypto()
    if crypto is None:
        raise RuntimeError("no OpenSSL library with SHA256_Update on this worker, though the driver has one")
    if state is None:
        context = _Context()
        crypto.SHA256_Init(ctypes.byref(context))
    else:
        context = _Context.from_buffer_copy(state)
    end = min(done + piece, size)
    with open(file, "rb", buffering=0) as f:
        status = os.fstat(f.fileno())
        seen = (status.st_size, status.st_mtime_ns)
        if seen != (stamp or (size, status.st_mtime_ns)):
            raise OSError(f"{file} was changed while its digest was made")
        f.seek(done)
        while done < end:
            block = f.read(min(_BLOCK_BYTES, end - done))
            if not block:
                raise OSError(f"{file} ended at byte {done} of {size} while its digest was made")
            crypto.SHA256_Update(ctypes.byref(context), block, len(block))
            done += len(block)
    if done < size:
        return key, file, size, done, bytes(context), seen
    digest = ctypes.create_string_buffer(32)
    crypto.SHA256_Final(digest, ctypes.byref(context))
    return key, file, size, done, digest.raw.hex(), seen


def sha256_by_pieces(context: SparkContext, files: list[tuple[str, str, int]], piece: int) -> list[tuple[str, str]]:
    """(key, SHA-256) of files, given as (key, path that workers can open, size): a job for each piece of the largest file.

    A task reads at most ``piece`` bytes. Between jobs the driver holds a row of some 200 bytes for each file, as it does when files are listed.
    """
    going, made = [(key, file, size, 0, None, None) for key, file, size in files], []
    while going:
        moved = context.parallelize(going, len(going)).map(lambda item: _advanced(item, piece)).collect()
        made += [(key, state) for key, _, size, done, state, _ in moved if done == size]
        going = [item for item in moved if item[3] < item[2]]
    return made
