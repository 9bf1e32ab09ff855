"""Single packets as bytes (RFC 6716, section 3.2 and appendix B): where their frames are, and packets of frames. operators/framing.py calls these in Arrow batches."""

from __future__ import annotations

from typing import NamedTuple

from framelake.functions.packets import MOST_FRAMES, MOST_SAMPLES

MOST_BYTES = 1275  # of a frame


class Parsed(NamedTuple):
    toc: int | None
    sizes: list[int] | None
    first: int | None
    padding: int | None
    used: int | None
    error: str | None


def frame_samples(toc: int) -> int:
    c = toc >> 3
    if c < 12:
        return 2880 if c % 4 == 3 else 480 << c % 4
    return 480 << c % 2 if c < 16 else 120 << c % 4


def parsed(d: bytes | None, delimited: bool = False) -> Parsed:
    """What operators.framing.parse() says of one packet."""
    n = len(d or b"")
    if not n:
        return Parsed(None, None, None, 0, None, "too short")
    toc, short, at, count, varies, padding = d[0], "invalid packet" if delimited else "too short", 1, 2, False, 0
    code = toc & 3
    bad = lambda error: Parsed(toc, None, None, padding, None, error)
    if code == 3:
        if n < 2:
            return bad(short)
        at, count, varies = 2, d[1] & 63, d[1] >= 128
        if d[1] & 64:
            while at < n and d[at] == 255:
                at += 1
            padding = 254 * (at - 2) + d[at] if at < n else None
            at += 1
    else:
        count, varies = min(code + 1, 2), code == 2
    if not 1 <= count <= MOST_FRAMES:
        return bad("invalid packet" if delimited else "invalid frame count")
    if code == 3 and count * frame_samples(toc) > MOST_SAMPLES:
        return bad("invalid packet")
    if padding is None:
        return bad(short)
    sizes = []
    for _ in range((count - 1 if varies else 0) + delimited):  # frames whose lengths are written
        if at >= n or (d[at] >= 252 and at + 1 >= n):
            return bad(short)
        a = d[at]
        sizes.append(a if a < 252 else a + 4 * d[at + 1])
        at += 1 if a < 252 else 2
    others = count - len(sizes)
    if delimited:
        sizes += sizes[-1:] * others
        used = at + padding + sum(sizes)
        late = used > n
    else:
        left, used = n - at - padding - sum(sizes), n
        late = left < 0 or left % others or left // others > MOST_BYTES
        sizes += [left // others] * others
    return bad("invalid packet") if late else Parsed(toc, sizes, at, padding, used, None)


def cut(d: bytes, p: Parsed) -> list[bytes] | None:
    """The frames of a parsed packet; null for a malformed one."""
    if p.error:
        return None
    out, at = [], p.first
    for n in p.sizes:
        out.append(d[at : at + n])
        at += n
    return out


def length_code(n: int) -> bytes:
    """The bytes of a frame's length: one below 252, else two."""
    low = 252 + n % 4
    return bytes([n]) if n < 252 else bytes([low, (n - low) // 4])


def built(toc: int | None, parts: list | None, delimited: bool = False, target: int | None = None, tail: bytes | None = None) -> bytes | None:
    """What operators.framing.build() makes of one packet's frames; without a target it isn't padded."""
    if toc is None or parts is None or not 1 <= len(parts) <= MOST_FRAMES or None in parts:
        return None
    m, sizes, body = len(parts), [len(x) for x in parts], b"".join(parts)
    same, kind = len(set(sizes)) == 1, toc & 252
    coded = ([] if same else sizes[:-1]) + (sizes[-1:] if delimited else [])
    if any(n > MOST_BYTES for n in coded):
        return None
    lengths = b"".join(map(length_code, coded))
    code, count = 0 if m == 1 else 3 if m > 2 else 1 if same else 2, m if same else m | 128
    plain = bytes([kind | code, count] if code == 3 else [kind | code]) + lengths + body
    if target is None or target == len(plain):
        return plain
    more = target - 2 - len(lengths) - len(body)  # bytes that are left, from the packet on that has a count byte
    if target < len(plain) or more < 0:
        return None
    if not more:
        return bytes([kind | 3, count]) + lengths + body
    full = (more - 1) // 255  # bytes of 255, each 254 of padding
    room = more - full - 1
    filler = bytes([1]) * (room - len(tail)) + tail if tail and any(tail) else bytes(room)
    return bytes([kind | 3, count | 64]) + bytes([255]) * full + bytes([more - 255 * full - 1]) + lengths + body + filler


def padded(d: bytes | None, target: int | None) -> tuple[bytes | None, str | None]:
    """The packet grown to so many bytes, and the error. Extensions in its padding are kept."""
    p = parsed(d)
    if p.error or target is None:
        return None, p.error
    if len(d) >= target:
        return (d, None) if len(d) == target else (None, "too long")
    return built(p.toc, cut(d, p), target=target, tail=d[p.used - p.padding : p.used]), None


def bare(d: bytes | None) -> tuple[bytes | None, str | None]:
    """The packet without padding, and the error."""
    p = parsed(d)
    return (None if p.error else built(p.toc, cut(d, p))), p.error


def split(d: bytes | None, streams: int) -> tuple[list[bytes] | None, int | None, str | None]:
    """The packets of so many streams in one, as they would stand alone; where the last of them begins; and the error."""
    out, spans, at = [], set(), 0
    for k in range(streams):
        last, rest = k == streams - 1, None if d is None else d[at:]
        p = parsed(rest, not last)
        if p.error:
            return None, at if last and d is not None else None, p.error
        out.append(rest if last else built(p.toc, cut(rest, p)))
        spans.add(len(p.sizes) * frame_samples(p.toc))
        at += 0 if last else p.used
    return (None, at, "different durations") if len(spans) > 1 else (out, at, None)
