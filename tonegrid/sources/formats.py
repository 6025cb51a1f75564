"""Headers and samples of uncompressed audio: RIFF, RF64 and BW64 WAVE; AIFF and AIFF-C without compression.

A header says where samples lie and how they are stored; any range of frames is then one ranged read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import NamedTuple

import numpy as np


class AudioError(ValueError):
    """A file that isn't the audio it should be."""


class Layout(NamedTuple):
    """Where and how a file holds its samples; ``kind`` is a numpy type, or ``<i3`` and ``>i3`` for 24 bits."""

    rate: int
    depth: int
    channels: int
    frames: int
    data: int
    kind: str

    @property
    def width(self) -> int:
        """Bytes of one frame."""
        return self.channels * (self.depth // 8)


#: Format tags of WAVE.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def _chunks(read: Callable[[int, int], bytes], size: int, at: int, order: str):
    """(name, position of the body, stated size) of each chunk of a file."""
    while at + 8 <= size:
        head = read(at, 8)
        length = struct.unpack(f"{order}I", head[4:])[0]
        told = yield head[:4], at + 8, length
        at += 8 + (length if told is None else told) + (length if told is None else told) % 2


def _wave(read: Callable[[int, int], bytes], size: int) -> Layout:
    form = data = long = None
    walk = _chunks(read, size, 12, "<")
    told = None
    while True:
        try:
            name, at, length = walk.send(told)
        except StopIteration:
            break
        told = None
        if name == b"ds64" and length >= 16:
            long = struct.unpack("<Q", read(at + 8, 8))[0]
        elif name == b"fmt " and length >= 16 and len(body := read(at, min(length, 40))) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == EXTENSIBLE and len(body) >= 26:
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            told = long if length == 0xFFFFFFFF and long is not None else length
            data = at, min(told, size - at)
    if form is None or data is None:
        raise AudioError("no format or no data chunk")
    tag, channels, rate, _, _, depth = form
    if not channels or not rate:
        raise AudioError("no channels or no sample rate")
    if tag == FLOAT and depth in (32, 64):
        kind = f"<f{depth // 8}"
    elif tag == PCM and depth in (8, 16, 24, 32):
        kind = "u1" if depth == 8 else f"<i{depth // 8}"
    else:
        raise AudioError(f"format {tag} of {depth} bits isn't read")
    return Layout(rate, depth, channels, data[1] // (channels * depth // 8), data[0], kind)


def _extended(raw: bytes) -> float:
    """An 80-bit floating-point number, big-endian."""
    sign, fraction = struct.unpack(">HQ", raw)
    return (-1.0 if sign & 0x8000 else 1.0) * fraction * 2.0 ** ((sign & 0x7FFF) - 16383 - 63)


def _aiff(read: Callable[[int, int], bytes], size: int) -> Layout:
    form = data = None
    for name, at, length in _chunks(read, size, 12, ">"):
        if name == b"COMM" and length >= 18:
            body = read(at, min(length, 22))
            channels, frames, depth = struct.unpack_from(">hIh", body)
            form = channels, frames, depth, _extended(body[8:18]), body[18:22] or b"NONE"
        elif name == b"SSND" and length >= 8:
            offset = struct.unpack(">I", read(at, 4))[0]
            data = at + 8 + offset, min(length - 8 - offset, size - at - 8 - offset)
    if form is None or data is None:
        raise AudioError("no common or no sound data chunk")
    channels, frames, depth, rate, packing = form
    if channels <= 0 or rate <= 0:
        raise AudioError("no channels or no sample rate")
    order = {b"NONE": ">", b"twos": ">", b"sowt": "<"}.get(packing)
    if order is None or depth not in (8, 16, 24, 32):
        raise AudioError(f"AIFF of {depth} bits, packed as {packing.decode('latin1')}, isn't read")
    return Layout(round(rate), depth, channels, min(frames, max(0, data[1]) // (channels * depth // 8)), data[0], "i1" if depth == 8 else f"{order}i{depth // 8}")


def layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """The header of a file of ``size`` bytes, of which ``read`` gives any range (position, length)."""
    head = read(0, 12)
    if head[:4] in (b"RIFF", b"RF64", b"BW64") and head[8:12] == b"WAVE":
        found = _wave(read, size)
    elif head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        found = _aiff(read, size)
    else:
        raise AudioError("not a RIFF WAVE file" if size else "the file is empty")
    if found.frames <= 0:
        raise AudioError("no samples")
    return found


def samples(raw: bytes, of: Layout) -> np.ndarray:
    """float32 samples by channel of whole frames, -1 to 1."""
    raw = raw[: len(raw) // of.width * of.width]
    if of.kind.endswith("i3"):
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        low, high = (0, 2) if of.kind[0] == "<" else (2, 0)
        x = ((b[:, low] << 8 | b[:, 1] << 16 | b[:, high] << 24) >> 8).astype(np.float32) / 2**23
    elif of.kind == "u1":
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif "f" in of.kind:
        x = np.frombuffer(raw, of.kind).astype(np.float32)
    else:
        x = (np.frombuffer(raw, of.kind) / 2.0 ** (of.depth - 1)).astype(np.float32)
    return x.reshape(-1, of.channels).T
