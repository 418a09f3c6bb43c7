"""Ogg media columns: write and read the Ogg container, and features of the audio that it holds.

Reading verifies each page's checksum (a page that fails is skipped up to the next capture pattern), puts packets together from
lacing values over page borders, parts the logical streams by their serial numbers, and gives each packet the time at which it
ends, from its page's granule position and the lengths of the packets behind it on that page.

The stored form of a payload has two logical streams with their pages in turn: unsigned 8-bit PCM, one byte of payload a sample,
in packets of up to 5000 samples; and an index whose packets hold the least and the greatest sample and the number of samples
of each such packet. A page has up to 32 lacing values, so packets go over page borders.

Faults are counted: places that are no sound page, gaps in a stream's page numbers, packets cut off, granule positions that the
packets' lengths don't lead to, and streams without their last page. Null media are empty, and have no streams.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns, map_texts, texts

RATE, FRAMES, SEGMENTS = 8000, 5000, 32
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct(">8sHHIIBBHI")
PCM_ID, INDEX_ID = b"PCM     ", b"INDEX8  "
#: Serial numbers of the two streams; constants, so that equal payloads have equal media.
SERIALS = (0x50434D38, 0x494E4458)


def checksum(page: bytes) -> int:
    """The container's CRC-32 (most significant bit first, from 0), by the mirrored one that zlib has."""
    crc = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIP), "big")


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages for packets with the granule position at each one's end; a stream's first packet has a page of its own."""
    number, lacing, body, granule, flags = 0, bytearray(), bytearray(), -1, 2

    def page(last: bool) -> bytes:
        head = _HEAD.pack(b"OggS", 0, flags | (4 if last else 0), granule, serial, number, 0, len(lacing)) + bytes(lacing)
        raw = head + bytes(body)
        return raw[:22] + checksum(raw).to_bytes(4, "little") + raw[26:]

    for k, (data, end) in enumerate(packets):
        values, at = [255] * (len(data) // 255) + [len(data) % 255], 0
        for i, v in enumerate(values):
            if len(lacing) == SEGMENTS:
                yield page(False)
                number, granule, flags = number + 1, -1, 1 if i else 0
                lacing.clear()
                body.clear()
            lacing.append(v)
            body += data[at : at + v]
            at += v
        granule = end
        if k == len(packets) - 1 or k == 0:
            yield page(k == len(packets) - 1)
            number, granule, flags = number + 1, -1, 0
            lacing.clear()
            body.clear()


def mux(streams: list[Iterator[bytes]]) -> bytes:
    """Pages of the streams in turn; all first pages come before any other."""
    out, streams = [], list(streams)
    while streams:
        for s in list(streams):
            if (p := next(s, None)) is None:
                streams.remove(s)
            else:
                out.append(p)
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule position at each packet's end; -1 if unknown
    pages: int = 0
    lost: int = 0  # packets cut by a missing or broken page
    gaps: int = 0  # pages that are not the one after the page before
    jumps: int = 0  # granule positions that differ from the packets' lengths, summed up since the last one known
    due: int | None = 0  # the granule position that those lengths lead to; None after a gap
    ended: bool = False
    expected: int | None = None
    part: bytearray | None = None

    @property
    def kind(self) -> bytes:
        return self.packets[0][:8] if self.packets else b""

    def take(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if number != (self.expected or 0):
            self.gaps, self.due = self.gaps + 1, None
            if self.part is not None:
                self.part, self.lost = None, self.lost + 1
        self.expected, self.pages, self.ended = number + 1, self.pages + 1, self.ended or bool(flags & 4)
        skip = bool(flags & 1) and self.part is None  # the rest of a packet whose beginning is missing
        if not flags & 1 and self.part is not None:
            self.part, self.lost = None, self.lost + 1
        at, done = 0, len(self.packets)
        for v in lacing:
            if not skip:
                if self.part is None:
                    self.part = bytearray()
                self.part += body[at : at + v]
            at += v
            if v < 255:
                if skip:
                    skip = False
                    self.lost += 1
                else:
                    self.packets.append(bytes(self.part))
                    self.ends.append(-1)
                    self.part = None
        end = granule
        for i in range(len(self.packets) - 1, done - 1, -1):
            self.ends[i] = end
            end = -1 if end < 0 else max(0, end - self.length(i))
        if self.due is not None:
            self.due += sum(self.length(i) for i in range(done, len(self.packets)))
        if granule >= 0:
            self.jumps += self.due is not None and self.due != granule
            self.due = granule

    @property
    def faults(self) -> int:
        return self.lost + self.gaps + self.jumps + (not self.ended)

    def length(self, i: int) -> int:
        """Samples of one packet, or those that an entry of the index stands for; headers have none."""
        if not i:
            return 0
        data = self.packets[i]
        return len(data) if self.kind == PCM_ID else int.from_bytes(data[2:4], "big") if self.kind == INDEX_ID else 0

    def seconds(self) -> list[float]:
        return [e / RATE if e >= 0 else float("nan") for e in self.ends]


def demux(media: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many places failed: bad checksums, cut pages and bytes between pages."""
    streams: dict[int, Stream] = {}
    at, bad = 0, 0
    while at < len(media):
        ok = media.startswith(b"OggS", at) and at + 27 <= len(media)
        if ok:
            _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
            lacing = media[at + 27 : at + 27 + n]
            size = 27 + n + sum(lacing)
            raw = media[at : at + size]
            ok = not version and len(raw) == size and checksum(raw[:22] + bytes(4) + raw[26:]) == crc
        if not ok:
            bad += 1
            at = media.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        streams.setdefault(serial, Stream(serial)).take(flags, granule, number, lacing, raw[27 + n :])
        at += size
    for s in streams.values():
        if s.part is not None:
            s.part, s.lost = None, s.lost + 1
    return streams, bad


def store(payload: bytes) -> bytes:
    """The payload's stored form."""
    head = _PCM.pack(PCM_ID, 0, 0, 1, RATE, 8, 1, FRAMES, 0)
    parts = [payload[i : i + FRAMES] for i in range(0, len(payload), FRAMES)]
    ends = [min(i + FRAMES, len(payload)) for i in range(0, len(payload), FRAMES)]
    index = [(bytes((min(p), max(p))) + len(p).to_bytes(2, "big"), e) for p, e in zip(parts, ends, strict=True)]
    return mux([pages_of(SERIALS[0], [(head, 0), *zip(parts, ends, strict=True)]), pages_of(SERIALS[1], [(INDEX_ID, 0), *index])])


def load(media: bytes) -> tuple[bytes, str]:
    """The payload of stored media, and its features: streams, pages, packets, faults, seconds, samples' mean, root mean square,
    crossings of the middle, and range (of the index)."""
    streams, bad = demux(media)
    sound = next((s for s in streams.values() if s.kind == PCM_ID), None)
    index = next((s for s in streams.values() if s.kind == INDEX_ID), None)
    payload = b"".join(sound.packets[1:]) if sound else b""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    seconds = max((e for e in sound.seconds() if e == e), default=0.0) if sound else 0.0
    faults = bad + sum(s.faults for s in streams.values())
    low = min((p[0] for p in index.packets[1:] if len(p) == 4), default=0) if index else 0
    high = max((p[1] for p in index.packets[1:] if len(p) == 4), default=0) if index else 0
    mean, power = (int(x.sum()) / len(x), int((x * x).sum(dtype=np.int64)) / len(x)) if len(x) else (0.0, 0.0)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    total = sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values())
    return payload, f"streams={len(streams)} pages={total[0]} packets={total[1]} faults={faults} seconds={seconds:.6f} mean={mean:.4f} rms={power**0.5:.4f} crossings={crossings} range={low}-{high}"


def payload_of(text: str) -> bytes:
    """The text as UTF-8 with bytes 0 up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) in its stored form."""

    def work(ids: list, values: list[str]) -> dict[str, list]:
        return {"doc_id": ids, "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in values], "media": [store(payload_of(t)) for t in values]}

    return map_texts(texts(docs), columns("doc_id long,n_bytes long,media binary"), work)


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, payload, feature of doc_id and media; null media are empty, and broken ones give what their sound pages hold."""

    def work(ids: list, values: list[bytes]) -> dict[str, list]:
        rows = [load(m or b"") for m in values]
        return {"doc_id": ids, "payload": [r[0] for r in rows], "feature": [r[1] for r in rows]}

    return map_texts(media.select("doc_id", F.coalesce("media", F.lit(b"")).alias("text")), columns("doc_id long,payload binary,feature string"), work)


def packets(media: DataFrame) -> DataFrame:
    """One row for each packet of doc_id and media: doc_id, serial, packet (from 0), seconds at its end (null if unknown), data."""

    def work(ids: list, values: list[bytes]) -> dict[str, list]:
        rows = [
            (i, s.serial, k, None if t != t else t, p)
            for i, m in zip(ids, values, strict=True)
            for s in demux(m or b"")[0].values()
            for k, (p, t) in enumerate(zip(s.packets, s.seconds(), strict=True))
        ]
        return {n: [r[c] for r in rows] for c, n in enumerate(("doc_id", "serial", "packet", "seconds", "data"))}

    return map_texts(media.select("doc_id", F.coalesce("media", F.lit(b"")).alias("text")), columns("doc_id long,serial long,packet int,seconds double,data binary"), work)


def digest_texts(docs: DataFrame) -> DataFrame:
    """Store each text, read it back, and digest both: see the contract's columns. Media don't leave the task."""
    import hashlib

    def work(ids: list, values: list[str]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for t in values:
            media = store(payload_of(t))
            payload, feature = load(media)
            row = (len(t.encode("utf-8", "surrogatepass")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return {"doc_id": ids} | out

    kinds = "doc_id long,n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string"
    return map_texts(texts(docs), columns(kinds), work)
