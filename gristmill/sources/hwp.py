"""Text of HWP 5 files: a compound file of streams, of which the sections hold compressed paragraph records."""

from __future__ import annotations

import struct
import zlib

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
SIGNATURE = b"HWP Document File"
#: The record that holds a paragraph's text.
PARAGRAPH_TEXT = 67
#: Control characters that take one code unit; the others below 32 take eight.
SINGLE = {0, 10, 13, *range(24, 32)}
NO_SECTOR = 0xFFFFFFFA  # this and larger numbers end a chain


class CompoundFile:
    """The streams of a compound file, by path."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        (directory,) = struct.unpack_from("<I", data, 48)
        self.cutoff, mini_start, _, difat, n_difat = struct.unpack_from("<5I", data, 56)
        tables = [x for x in struct.unpack_from("<109I", data, 76) if x < NO_SECTOR]
        for _ in range(n_difat):
            if difat >= NO_SECTOR:
                break
            *more, difat = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            tables += [x for x in more if x < NO_SECTOR]
        self.fat = [x for t in tables for x in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        self.mini_fat = [x for t in self._chain(mini_start, self.fat) for x in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        entries = b"".join(map(self._sector, self._chain(directory, self.fat)))
        self.entries = [entries[k:k + 128] for k in range(0, len(entries), 128)]
        self.mini = b""
        start, length = self._place(0)
        self.mini = b"".join(map(self._sector, self._chain(start, self.fat)))[:length]
        self.streams: dict[str, int] = {}
        self._walk(struct.unpack_from("<I", self.entries[0], 76)[0], "")

    def _sector(self, k: int) -> bytes:
        found = self.data[(k + 1) * self.size:(k + 2) * self.size]
        if not found:
            raise ValueError("a sector lies behind the end")
        return found.ljust(self.size, b"\0")

    def _chain(self, k: int, table: list[int]) -> list[int]:
        out: list[int] = []
        while k < NO_SECTOR:
            if k >= len(table) or len(out) > len(table):
                raise ValueError("a chain of sectors has no end")
            out.append(k)
            k = table[k]
        return out

    def _place(self, entry: int) -> tuple[int, int]:
        return struct.unpack_from("<II", self.entries[entry], 116)

    def _walk(self, top: int, above: str) -> None:
        """Entries are trees of siblings; one with a child is a folder."""
        held, seen = [(top, above)], set()
        while held:
            k, path = held.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            entry = self.entries[k]
            (length,) = struct.unpack_from("<H", entry, 64)
            name = path + entry[:max(0, length - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<3I", entry, 68)
            held += [(left, path), (right, path)]
            if entry[66] == 1:
                held.append((child, f"{name}/"))
            elif entry[66] == 2:
                self.streams[name] = k

    def read(self, path: str) -> bytes:
        start, length = self._place(self.streams[path])
        if length < self.cutoff:
            parts = [self.mini[k * self.mini_size:(k + 1) * self.mini_size] for k in self._chain(start, self.mini_fat)] if length else []
        else:
            parts = [self._sector(k) for k in self._chain(start, self.fat)]
        return b"".join(parts)[:length]


def paragraph(units: bytes) -> str:
    """The text of a paragraph record: controls of eight units are skipped, line ends and tabs kept."""
    codes = struct.unpack(f"<{len(units) // 2}H", units[:len(units) // 2 * 2])
    out: list[int] = []
    k = 0
    while k < len(codes):
        c = codes[k]
        if c >= 32:
            out.append(c)
        elif c == 9 or c == 10:
            out.append(c)
        k += 1 if c >= 32 or c in SINGLE else 8
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace").strip()


def section_text(data: bytes) -> list[str]:
    """The paragraphs of a section's records."""
    out, at = [], 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        tag, size = head & 0x3FF, head >> 20
        at += 4
        if size == 0xFFF:
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if tag == PARAGRAPH_TEXT and (text := paragraph(data[at:at + size])):
            out.append(text)
        at += size
    return out


def hwp_text(data: bytes) -> str:
    """The text of an HWP 5 file, a line for each paragraph; that of its preview if its sections have none.

    An error for other compound files, and for files with a password or that are locked for distribution.
    """
    file = CompoundFile(data)
    head = file.read("FileHeader") if "FileHeader" in file.streams else b""
    if not head.startswith(SIGNATURE) or len(head) < 40:
        raise ValueError("not an HWP 5 file")
    (flags,) = struct.unpack_from("<I", head, 36)
    if flags & 0b110:
        raise ValueError("the file is encrypted")
    out: list[str] = []
    for name in sorted((n for n in file.streams if n.startswith("BodyText/Section")), key=lambda n: int("".join(filter(str.isdigit, n)) or 0)):
        raw = file.read(name)
        try:
            out += section_text(zlib.decompress(raw, -15) if flags & 1 else raw)
        except (zlib.error, struct.error) as e:
            raise ValueError(f"{name}: {e}") from e
    if not out and "PrvText" in file.streams:
        return file.read("PrvText").decode("utf-16-le", "replace").strip("\0").strip()
    return "\n".join(out)
