"""AVI with motion-JPEG: writer, RIFF parser, intra-frame decoder and shot detection.

Samples are kept without loss in baseline JPEG: a sample is one flat 8 x 8
block. With a quantiser of 8 its DC coefficient is the sample less 128, and
there is no AC coefficient. The Huffman table gives category c a code of 9 - c
bits, so code and extra bits of every difference are 9 bits, with the end of
block 10: whole frames are coded and decoded as arrays. Any other single
component baseline frame is decoded bit by bit.
"""

import struct
from functools import lru_cache

import numpy as np

COLS = 64
ROWS = 16
FPS = 25
BINS = 16
#: Fixed values of ITU T.81: order of the coefficients of a block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_DC = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_AC = bytes([1] + [0] * 15) + b"\x00"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(256)
def _jpeg_head(width: int, height: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + bytes([8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, b"\x00" + _DC)
        + _segment(0xC4, b"\x10" + _AC)
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def _difference_codes() -> np.ndarray:
    """The 10 bits of each difference from -255 to 255, with the end of block."""
    codes = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = ((1 << (8 - c)) - 1) << 1
        codes[d + 255] = (prefix << c | (d if d > 0 else d + (1 << c) - 1)) << 1
    return codes


_CODES = _difference_codes()


def encode_frames(samples: np.ndarray, rows: int) -> list[bytes]:
    """JPEG frames of ``rows`` x COLS samples each; ``samples`` holds whole frames."""
    per = rows * COLS
    level = samples.reshape(-1, per).astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0))
    codes = _CODES[diff + 255].astype(np.uint64).reshape(-1, 4)
    word = codes[:, 0] << np.uint64(30) | codes[:, 1] << np.uint64(20) | codes[:, 2] << np.uint64(10) | codes[:, 3]
    raw = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(len(level), -1)
    head = _jpeg_head(COLS * 8, rows * 8)
    return [head + r.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for r in raw]


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, comment: str) -> bytes:
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 10_000, 0, 0, 0, width & 0x7FFF, height & 0x7FFF)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment.encode() + b"\x00"))
    chunks = [_chunk(b"00dc", f) for f in frames]
    at, index = 4, []
    for f, c in zip(frames, chunks):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    movi = _chunk(b"LIST", b"movi" + b"".join(chunks))
    body = b"AVI " + hdrl + info + movi + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> dict:
    """width, height, micros per frame, comment, and frames by the RIFF index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"comment": ""}
    movi = index = None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            tag, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if tag == b"LIST":
                kind = data[at + 8:at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif tag == b"avih":
                v = struct.unpack_from("<14I", data, at + 8)
                out |= {"micros": v[0], "frames": v[4], "width": v[8], "height": v[9]}
            elif tag == b"ICMT":
                out["comment"] = data[at + 8:at + 8 + size].rstrip(b"\x00").decode()
            elif tag == b"idx1":
                index = (at + 8, size)
            at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no movie list or index")
    entries = np.frombuffer(data, "<u4", index[1] // 4, index[0]).reshape(-1, 4)
    places = entries[entries[:, 0] == int.from_bytes(b"00dc", "little")][:, 2:].tolist()
    out["images"] = [data[movi + o + 8:movi + o + 8 + n] for o, n in places]
    return out


def _canonical(bits: bytes, values: bytes) -> list[tuple[int, int, int]]:
    """(length, code, value) of a Huffman table."""
    got, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            got.append((length, code, values[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return got


class _Tables:
    """What a JPEG header says; ``flat`` decodes frames of constant code width as arrays."""

    def __init__(self, head: bytes):
        self.quant, self.huff, at = {}, {}, 2
        while at + 4 <= len(head):
            marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4:at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1:65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                    body = body[65 + 64 * wide:]
            elif marker == 0xC0:
                depth, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if depth != 8 or parts != 1:
                    raise ValueError("only 8-bit frames of one component are decoded")
                self.table = body[8]
            elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                raise ValueError("only baseline frames are decoded")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huff[body[0]] = _canonical(body[1:17], body[17:17 + n])
                    body = body[17 + n:]
            elif marker == 0xDD and struct.unpack(">H", body)[0]:
                raise ValueError("restart intervals are not decoded")
            elif marker == 0xDA:
                self.dc, self.ac = self.huff[body[2] >> 4], self.huff[0x10 | body[2] & 15]
            at += 2 + size
        self.q = self.quant[self.table]
        self.blocks = -(-self.width // 8), -(-self.height // 8)
        widths = {length + cat for length, _, cat in self.dc}
        self.flat = None
        if len(widths) == 1 and len(self.ac) == 1 and self.ac[0][2] == 0:
            (w,) = widths
            self.width_bits, self.flat = w + self.ac[0][0], np.full(1 << w, 1 << 20, np.int64)
            for length, code, cat in self.dc:
                v = np.arange(1 << cat)
                self.flat[(code << cat) + v] = np.where(v >= (1 << cat >> 1), v, v - (1 << cat) + 1) if cat else 0

    def dc_levels(self, scans: list[bytes]) -> np.ndarray:
        """Frames x blocks of DC coefficients before dequantising."""
        n, w = self.blocks[0] * self.blocks[1], self.width_bits
        size = -(-n * w // 8)
        raw = np.frombuffer(b"".join(s.replace(b"\xff\x00", b"\xff")[:size] for s in scans), np.uint8).reshape(len(scans), size)
        if w == 10 and n % 4 == 0:
            b = raw.reshape(-1, 5).astype(np.int16)
            codes = np.empty((len(b), 4), np.int16)
            codes[:, 0] = b[:, 0] << 2 | b[:, 1] >> 6
            codes[:, 1] = (b[:, 1] & 63) << 4 | b[:, 2] >> 4
            codes[:, 2] = (b[:, 2] & 15) << 6 | b[:, 3] >> 2
            codes[:, 3] = (b[:, 3] & 3) << 8 | b[:, 4]
            codes = codes.reshape(len(scans), n)
        else:
            bits = np.unpackbits(raw, axis=1)[:, :n * w].reshape(len(scans), n, w)
            codes = bits @ (1 << np.arange(w)[::-1])
        return np.cumsum(self.flat[codes >> (w - len(self.flat).bit_length() + 1)], axis=1)

    def generic(self, scan: bytes) -> np.ndarray:
        """Pixels of a frame, bit by bit."""
        bits = np.unpackbits(np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist() + [1] * 64
        dc, ac = ({(length, code): v for length, code, v in t} for t in (self.dc, self.ac))
        at, last = 0, 0

        def symbol(table):
            nonlocal at
            code = 0
            for length in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("bad code in a scan")

        def extra(n):
            nonlocal at
            v = 0
            for b in bits[at:at + n]:
                v = v << 1 | b
            at += n
            return v if n == 0 or v >= 1 << (n - 1) else v - (1 << n) + 1

        cols, rows = self.blocks
        coef = np.zeros((rows * cols, 64))
        for block in coef:
            last += extra(symbol(dc))
            block[0], k = last, 1
            while k < 64:
                rs = symbol(ac)
                if rs == 0:
                    break
                k += rs >> 4
                if rs & 15:
                    block[k] = extra(rs & 15)
                k += 1
        flat = np.zeros_like(coef)
        flat[:, ZIGZAG] = coef * self.q
        u = np.arange(8)
        basis = np.cos((2 * u[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
        pixels = np.clip(np.rint(basis @ flat.reshape(-1, 8, 8) @ basis.T + 128), 0, 255).astype(np.uint8)
        return pixels.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)[:self.height, :self.width]


@lru_cache(512)
def _tables(head: bytes) -> _Tables:
    return _Tables(head)


def _split_scan(image: bytes) -> tuple[bytes, bytes]:
    """(header through the start of scan, entropy-coded bytes)."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while True:
        marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            end = image.rfind(b"\xff\xd9")
            return image[:at], image[at:end if end >= at else len(image)]


def decode_frames(images: list[bytes]) -> list[np.ndarray]:
    """Luma of each frame; flat frames come as one sample per block."""
    if not images:
        return []
    # Frames of a stream share their header: it is parsed once.
    first, scan = _split_scan(images[0])
    scans = [scan] + [i[len(first):-2] if i.startswith(first) and i.endswith(b"\xff\xd9") else None for i in images[1:]]
    t = _tables(first)
    if t.flat is not None and None not in scans:
        levels = t.dc_levels(scans) * int(t.q[0]) // 8 + 128
        return list(np.clip(levels, 0, 255).astype(np.uint8))
    out = []
    for i in images:
        head, scan = _split_scan(i)
        t = _tables(head)
        out.append(np.clip(t.dc_levels([scan])[0] * int(t.q[0]) // 8 + 128, 0, 255).astype(np.uint8) if t.flat is not None else t.generic(scan))
    return out


def shots(frames: list[np.ndarray], window: int = 8, spread: float = 3.0, floor: float = 0.12, alone: float = 0.35) -> list[tuple[int, int]]:
    """(first, last) frame of each shot.

    A cut is where the histogram difference exceeds the mean of the shot's last
    ``window`` differences by ``spread`` deviations and is over ``floor``; with
    fewer than two differences known, where it is over ``alone``.
    """
    if not frames:
        return []
    if len({f.size for f in frames}) == 1:
        all_ = np.stack([f.ravel() for f in frames])
        keys = (all_ >> 4).astype(np.int64) + np.arange(len(frames))[:, None] * BINS
        hist = np.bincount(keys.ravel(), minlength=BINS * len(frames)).reshape(-1, BINS) / all_.shape[1]
    else:
        hist = np.stack([np.bincount(f.ravel() >> 4, minlength=BINS) / f.size for f in frames])
    diffs = (np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2).tolist()
    got, first, seen = [], 0, []
    for i, d in enumerate(diffs, 1):
        if len(seen) >= 2:
            mean = sum(seen) / len(seen)
            limit = max(floor, mean + spread * (sum((x - mean) ** 2 for x in seen) / len(seen)) ** 0.5)
        else:
            limit = alone
        if d > limit:
            got.append((first, i - 1))
            first, seen = i, []
        else:
            seen = [*seen[-window + 1:], d]
    return [*got, (first, len(frames) - 1)]


def payload_to_avi(payload: bytes) -> bytes:
    """A payload of whole rows of COLS bytes as frames of up to ROWS rows; the last is filled with zeros."""
    rows = min(ROWS, len(payload) // COLS)
    data = np.frombuffer(payload, np.uint8)
    short = -len(data) % (rows * COLS)
    if short:
        data = np.concatenate([data, np.zeros(short, np.uint8)])
    return write_avi(encode_frames(data, rows), COLS * 8, rows * 8, f"payload_bytes={len(payload)}")


def avi_to_payload(data: bytes) -> tuple[bytes, dict, list[np.ndarray]]:
    """(payload, file facts, frames) read back from the stored bytes."""
    film = read_avi(data)
    frames = decode_frames(film["images"])
    size = int(film["comment"].partition("payload_bytes=")[2])
    return b"".join(f.tobytes() for f in frames)[:size], film, frames
