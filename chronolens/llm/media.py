"""Media columns: what stored bytes really are, by signatures, and media embedded in them.

One Aho-Corasick pass over the bytes finds every place where a known signature begins; the format's validator then walks the structure from there
(chunks, boxes, blocks, lengths, checksums where the format has them) and says where the medium ends, or rejects it. A medium that begins at byte 0
and, padding aside, takes up the payload gives its type, which corrects the declared one; media found further in are carved.

Null bytes: no type, no spans, not corrected. Empty bytes: likewise. A payload of any length is read whole. Where several media begin at one place,
the longest counts, then the smaller kind name. Equal payloads give equal results; an empty table gives an empty table; input columns pass through
unless an output column has their name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import fields, map_rows, texts

# Signatures of public formats, each with its kind and the place in the format where it stands.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"BM", "image/bmp", 0),
    (b"RIFF", "riff", 0),
    (b"OggS", "audio/ogg", 0),
    (b"fLaC", "audio/flac", 0),
    (b"ftyp", "video/mp4", 4),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"\x1f\x8b\x08", "application/gzip", 0),
]

# RIFF forms.
RIFF_FORMS = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}

# Names of boxes that may stand at the top of an ISO media file.
MP4_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"udta", b"pdin"}

# ---- validators: (data, start) -> (kind, end) or None ----


def _png(d: bytes, at: int):
    p, first, image = at + 8, True, False
    while p + 12 <= len(d):
        n = int.from_bytes(d[p : p + 4], "big")
        kind, end = d[p + 4 : p + 8], p + 12 + n
        if end > len(d) or not kind.isalpha() or (first and (kind != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(d[p + 4 : p + 8 + n]) != int.from_bytes(d[end - 4 : end], "big"):
            return None
        image |= kind == b"IDAT"
        if kind == b"IEND":
            return ("image/png", end) if image and n == 0 else None
        p, first = end, False
    return None


def _gif(d: bytes, at: int):
    if at + 13 > len(d):
        return None
    flags, p, frames = d[at + 10], at + 13, 0
    p += 3 * (2 << (flags & 7)) if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += d[p] + 1
        return p + 1 if p < len(d) else len(d) + 1

    while p < len(d):
        if d[p] == 0x3B:
            return ("image/gif", p + 1) if frames else None
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 11 <= len(d):
            local = d[p + 9]
            p = blocks(p + 11 + (3 * (2 << (local & 7)) if local & 0x80 else 0))
            frames += 1
        else:
            return None
    return None


def _jpeg(d: bytes, at: int):
    p, scan = at + 2, False
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return None
        m = d[p + 1]
        if m == 0xFF:
            p += 1
        elif m == 0xD9:
            return ("image/jpeg", p + 2) if scan else None
        elif m in (0x00, 0x01) or 0xD0 <= m <= 0xD8:
            return None
        else:
            n = int.from_bytes(d[p + 2 : p + 4], "big")
            if n < 2:
                return None
            p += 2 + n
            if m == 0xDA:
                scan = True
                while True:
                    p = d.find(b"\xff", p)
                    if p < 0 or p + 1 >= len(d):
                        return None
                    if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                        p += 2
                    else:
                        break
    return ("image/jpeg", p + 2) if scan and d[p : p + 2] == b"\xff\xd9" else None


def _bmp(d: bytes, at: int):
    if at + 30 > len(d):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", d, at + 2)
    planes, bits = struct.unpack_from("<HH", d, at + 26)
    good = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= size and at + size <= len(d)
    return ("image/bmp", at + size) if good else None


def _riff(d: bytes, at: int):
    if at + 12 > len(d) or (kind := RIFF_FORMS.get(d[at + 8 : at + 12])) is None:
        return None
    end = at + 8 + int.from_bytes(d[at + 4 : at + 8], "little")
    if end > len(d) or end < at + 20:
        return None
    p, names = at + 12, set()
    while p + 8 <= end:
        names.add(d[p : p + 4])
        n = int.from_bytes(d[p + 4 : p + 8], "little")
        p += 8 + n + (n & 1)
    need = {"audio/wav": {b"fmt ", b"data"}, "video/avi": {b"LIST"}}.get(kind, set())
    whole = p == end or p == end + 1
    return (kind, end) if whole and need <= names and (kind != "image/webp" or names & {b"VP8 ", b"VP8L", b"VP8X"}) else None


def _ogg_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = ((r << 1) ^ (0x04C11DB7 if r & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(r)
    return out


_OGG_CRC = _ogg_table()


def _ogg(d: bytes, at: int):
    p, last = at, False
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d) and d[p + 4] == 0 and not last:
        n = d[p + 26]
        end = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if end > len(d) or (p == at and not d[p + 5] & 2):
            return None
        crc = 0
        for b in d[p : p + 22] + b"\0\0\0\0" + d[p + 26 : end]:
            crc = ((crc << 8) & 0xFFFFFFFF) ^ _OGG_CRC[(crc >> 24) ^ b]
        if crc != int.from_bytes(d[p + 22 : p + 26], "little"):
            return None
        last, p = bool(d[p + 5] & 4), end
    return ("audio/ogg", p) if p > at else None


def _flac(d: bytes, at: int):
    p, first = at + 4, True
    while p + 4 <= len(d):
        last, kind, n = d[p] & 0x80, d[p] & 0x7F, int.from_bytes(d[p + 1 : p + 4], "big")
        if (first and (kind != 0 or n != 34)) or kind == 127 or p + 4 + n > len(d):
            return None
        p, first = p + 4 + n, False
        if last:  # frames have no length: they go to the end of the payload
            return ("audio/flac", len(d)) if d[p : p + 1] == b"\xff" and p + 1 < len(d) and d[p + 1] & 0xFC == 0xF8 else None
    return None


def _mp4(d: bytes, at: int):
    p, names = at, []
    while p + 8 <= len(d) and d[p + 4 : p + 8] in MP4_BOXES:
        n = int.from_bytes(d[p : p + 4], "big")
        if n == 1 and p + 16 <= len(d):
            n = int.from_bytes(d[p + 8 : p + 16], "big")
        if n < 8 or p + n > len(d) or (names and d[p + 4 : p + 8] == b"ftyp"):
            break
        names.append(d[p + 4 : p + 8])
        p += n
    return ("video/mp4", p) if names[:1] == [b"ftyp"] and len(names) > 1 else None


def _pdf(d: bytes, at: int):
    if not d[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    nxt = d.find(b"%PDF-", at + 5)
    end = d.rfind(b"%%EOF", at, nxt if nxt >= 0 else len(d))
    return ("application/pdf", end + 5) if end >= 0 and d.rfind(b"startxref", at, end) >= 0 else None


def _zip_ends(d: bytes) -> dict[int, int]:
    """Start -> end of the archives whose end records are in d: each record says how far before it its archive begins. One pass, however many entries."""
    out, p = {}, -1
    while (p := d.find(b"PK\x05\x06", p + 1)) >= 0 and p + 22 <= len(d):
        n, size, offset = struct.unpack_from("<HII", d, p + 10)
        at, end = p - offset - size, p + 22 + int.from_bytes(d[p + 20 : p + 22], "little")
        if at >= 0 and end <= len(d) and (n == 0 or d[at + offset : at + offset + 4] == b"PK\x01\x02"):
            out.setdefault(at, end)
    return out


def _gzip(d: bytes, at: int):
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    z = zlib.decompressobj(31)
    try:
        rest = memoryview(d)[at:]
        while rest and not z.eof:  # in pieces: the output isn't kept
            z.decompress(rest[:65536])
            left = len(z.unused_data) if z.eof else 0
            at += min(65536, len(rest)) - left
            rest = rest[65536:]
    except zlib.error:
        return None
    return ("application/gzip", at) if z.eof else None


VALIDATORS = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "riff": _riff, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4, "application/pdf": _pdf, "application/gzip": _gzip}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, kind, at in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (len(magic) - 1 + at, kind))
    out.make_automaton()
    return out


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """The confirmed media in data as (kind, start, end), by start; media inside a confirmed one's span are listed too, but not in a RIFF's,
    ZIP's or gzip's own chunks that repeat its signature (a validator starts there as anywhere and must confirm)."""
    best: dict[int, tuple[int, str]] = {}
    zips: dict[int, int] | None = None
    for last, (back, kind) in _automaton().iter(data.decode("latin-1")):
        start = last - back
        if start < 0 or (kind == "audio/ogg" and any(k == kind and s < start < e for s, (e, k) in best.items())):
            continue
        if kind == "application/zip":
            zips = _zip_ends(data) if zips is None else zips
            found = (kind, zips[start]) if start in zips else None
        else:
            found = VALIDATORS[kind](data, start)
        if found:
            kind, end = found
            if start not in best or (-end, kind) < (-best[start][0], best[start][1]):
                best[start] = (end, kind)
    return [(k, s, e) for s, (e, k) in sorted(best.items())]


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """A mono WAV of 8-bit samples whose data chunk is payload."""
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(media: bytes) -> bytes:
    """The data chunk, by the chunk lengths in the stored bytes."""
    p = 12
    while p + 8 <= len(media):
        n = int.from_bytes(media[p + 4 : p + 8], "little")
        if media[p : p + 4] == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def identify(df: DataFrame, bytes_col: str = "media", declared_col: str | None = None, carve: bool = False) -> DataFrame:
    """Adds media_type (null if none is confirmed at byte 0), corrected (a confirmed type that isn't the declared one), spans
    array<struct<kind,start,end>> and, if asked, carved array<binary>: the bytes of the spans that don't begin at 0."""
    out = fields("media_type string, corrected boolean, spans array<struct<kind:string,start:bigint,end:bigint>>" + ", carved array<binary>" * carve)

    def make():
        def run(batch):
            kinds, wrong, spans, parts = [], [], [], []
            at = batch.schema.get_field_index
            said = batch.column(at(declared_col)).to_pylist() if declared_col else [None] * batch.num_rows
            for data, was in zip(batch.column(at(bytes_col)).to_pylist(), said):
                found = sniff(data or b"")
                kind = next((k for k, s, _ in found if s == 0), None)
                kinds.append(kind)
                wrong.append(kind is not None and kind != was)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                parts.append([data[s:e] for _, s, e in found if s])
            return (kinds, wrong, spans, parts)[: 3 + carve]

        return run

    return map_rows(df, make, out, needs=[bytes_col, *([declared_col] if declared_col else [])])


def store_texts(df: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """Adds out_col binary: the text's UTF-8, padded with bytes 0 to a positive multiple of 64, as a WAV."""

    def make():
        return lambda batch: [[wav(padded(x.encode("utf-8", "surrogatepass"))) for x in texts(batch, text_col)]]

    return map_rows(df, make, fields(f"`{out_col}` binary"), needs=[text_col])


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def text_digests(df: DataFrame, text_col: str = "text", declared: str = "application/octet-stream", keep: list[str] | None = None) -> DataFrame:
    """store_texts, then identify and features of what is read back from the stored bytes, in one pass.

    feature: confirmed type, whether it corrects the declared one, carved spans (kind:start:end), then the samples' mean, standard deviation and
    byte entropy to four places, each after a semicolon.
    """
    out = fields("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

    def make():
        def run(batch):
            rows = []
            for x in texts(batch, text_col):
                raw = x.encode("utf-8", "surrogatepass")
                media = wav(padded(raw))
                found = sniff(media)
                kind = next((k for k, s, _ in found if s == 0), None)
                payload = wav_samples(media)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(kind, kind is not None and kind != declared, [f for f in found if f[1]], payload)))
            return list(zip(*rows)) if rows else [[] for _ in out]

        return run

    return map_rows(df, make, out, keep=keep, needs=[text_col])


def _feature(kind: str | None, corrected: bool, carved: list, payload: bytes) -> str:
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.float64)
    p = n / n.sum()
    levels = np.arange(256.0)
    mean = float(p @ levels)
    spread = float(np.sqrt(max(0.0, p @ levels**2 - mean * mean)))
    q = p[p > 0]
    entropy = max(0.0, float(-(q * np.log2(q)).sum()))
    spans = ",".join(f"{k}:{s}:{e}" for k, s, e in carved)
    return f"{kind or ''};{'corrected' if corrected else 'as declared'};{spans};{mean:.4f};{spread:.4f};{entropy:.4f}"
