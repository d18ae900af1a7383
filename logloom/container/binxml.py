"""A decoder of binary XML payloads. Bounds are checked everywhere; bad input raises BadXml and nothing else.

A decoder belongs to a chunk: names and templates are referred to by their offset in it.
"""

from __future__ import annotations

import re
import struct
from codecs import utf_16_le_decode
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

# ---- Fixed values ----
MOST_DEPTH, MOST_TOKENS, MOST_VALUES = 256, 1 << 20, 4096
CHUNK_END = 0x10000
_INTS = {0x03: "<b", 0x04: "<B", 0x05: "<h", 0x06: "<H", 0x07: "<i", 0x08: "<I", 0x09: "<q", 0x0A: "<Q", 0x0B: "<f", 0x0C: "<d"}
_INT, _SHORT, _ITEM = struct.Struct("<I"), struct.Struct("<H"), struct.Struct("<HBB")
#: A name's place and, if it stands right there, its length; a literal's token, type and length.
_NAMED, _LITERAL = struct.Struct("<I6xH"), struct.Struct("<BBH")
# ---- End of fixed values ----


class BadXml(ValueError):
    pass


@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list["Element | str"] = field(default_factory=list)

    def text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def elements(self) -> list["Element"]:
        return [c for c in self.children if isinstance(c, Element)]

    def child(self, name: str) -> "Element | None":
        return next((c for c in self.elements() if c.name == name), None)


def filetime_text(ticks: int) -> str:
    try:
        return (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    except OverflowError:
        return str(ticks)


def guid_text(b: bytes) -> str:
    a, c, d = struct.unpack("<IHH", b[:8])
    return f"{a:08x}-{c:04x}-{d:04x}-{b[8:10].hex()}-{b[10:].hex()}"


def value_text(kind: int, b: bytes) -> str:
    """A value of a known type and size as text."""
    try:
        if kind == 0x00:
            return ""
        if kind == 0x01:
            return b[: len(b) // 2 * 2].decode("utf-16-le", "replace").rstrip("\x00")
        if kind == 0x02:
            return b.decode("latin-1").replace("\x00", "")
        if kind in _INTS:
            return str(struct.unpack(_INTS[kind], b[: struct.calcsize(_INTS[kind])])[0])
        if kind == 0x0D:
            return "true" if any(b[:4]) else "false"
        if kind == 0x0E:
            return b.hex()
        if kind == 0x0F:
            return guid_text(b[:16])
        if kind in (0x10, 0x14, 0x15):
            wide = len(b) >= 8 if kind == 0x10 else kind == 0x15
            return f"0x{struct.unpack('<Q' if wide else '<I', b[: 8 if wide else 4])[0]:0{16 if wide else 8}x}"
        if kind == 0x11:
            return filetime_text(struct.unpack("<Q", b[:8])[0])
        if kind == 0x12:
            y, mo, _, d, h, mi, s, ms = struct.unpack("<8H", b[:16])
            return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}.{ms:03d}Z"
        if kind == 0x13:
            n = min(b[1], 64)
            return "-".join(["S", str(b[0]), str(int.from_bytes(b[2:8], "big")), *map(str, struct.unpack(f"<{n}I", b[8 : 8 + 4 * n]))])
        if kind == 0x81:
            return "\n".join(b.decode("utf-16-le", "replace").rstrip("\x00").split("\x00"))
    except (struct.error, IndexError) as e:
        raise BadXml(f"value of type {kind:#x} is cut off") from e
    raise BadXml(f"no value type {kind:#x}")


class ChunkDecoder:
    def __init__(self, chunk: bytes):
        self.chunk = chunk
        self.names: dict[int, tuple[str, int]] = {}
        self.said: dict[bytes, str] = {}

    def _get(self, form: str, at: int):
        try:
            return struct.unpack_from(form, self.chunk, at)[0]
        except struct.error as e:
            raise BadXml(f"cut off at {at}") from e

    def _name(self, at: int) -> tuple[str, int]:
        """The name a reference at `at` gives, and where the text goes on."""
        try:
            ref = _INT.unpack_from(self.chunk, at)[0]
            if ref not in self.names:
                end = ref + 8 + 2 * _SHORT.unpack_from(self.chunk, ref + 6)[0]
                if end + 2 > len(self.chunk):
                    raise BadXml(f"name at {ref} is cut off")
                raw = self.chunk[ref + 8 : end]
                if raw not in self.said:
                    self.said[raw] = utf_16_le_decode(raw, "replace", True)[0]
                self.names[ref] = (self.said[raw], end + 2)
        except struct.error as e:
            raise BadXml(f"name cut off at {at}") from e
        name, end = self.names[ref]
        return name, end if ref == at + 4 else at + 4

    def decode(self, at: int, end: int) -> Element:
        """The root element of the fragment in [at, end) of the chunk."""
        self.tokens = 0
        roots, _ = self._nodes(at, min(end, len(self.chunk)), None, 0)
        found = [r for r in roots if isinstance(r, Element)]
        if not found:
            raise BadXml("no element")
        return found[0]

    def _nodes(self, at: int, end: int, values: list | None, depth: int) -> tuple[list, int]:
        """Nodes up to the end of a fragment; values: those of the template being filled."""
        if depth > MOST_DEPTH:
            raise BadXml("too deep")
        # Names that stand where they are used and literal texts, most of a payload, are read here; _name() and _value() know all others.
        top = Element("")
        stack, chunk, said, size = [top], self.chunk, self.said, len(self.chunk)
        named, literal, head = _NAMED.unpack_from, _LITERAL.unpack_from, 5 if values is None else 7
        while at < end:
            self.tokens += 1
            if self.tokens > MOST_TOKENS:
                raise BadXml("too many tokens")
            byte = chunk[at]
            token = byte & 0x0F
            if byte & 0xB0:
                raise BadXml(f"no token {byte:#x}")
            if token == 0x01 or token == 0x06:
                place = at + (head if token == 0x01 else 1)
                name = None
                if place + 12 <= size:
                    ref, n = named(chunk, place)
                    if ref == place + 4:
                        name, at = said.get(chunk[place + 12 : place + 12 + 2 * n]), place + 14 + 2 * n
                if name is None or at > size:
                    name, at = self._name(place)
                if token == 0x01:
                    if byte & 0x40:
                        at += 4
                    if len(stack) > MOST_DEPTH:
                        raise BadXml("too deep")
                    element = Element(name)
                    stack[-1].children.append(element)
                    stack.append(element)
                    continue
            elif token == 0x02:
                at += 1
                continue
            elif token == 0x03 or token == 0x04:
                at += 1
                if len(stack) > 1:
                    stack.pop()
                continue
            elif token == 0x00:
                at += 1
                break
            elif token == 0x0F:
                at += 4
                continue
            elif token == 0x0C:
                parts, at = self._template(at, depth)
                stack[-1].children += parts
                continue
            elif token not in (0x05, 0x0D, 0x0E):
                raise BadXml(f"no support for token {byte:#x}")
            # The value of an attribute, or one among an element's children.
            text = None
            if at + 4 <= size:
                kind, form, n = literal(chunk, at)
                if kind & 0x0F == 0x05 and form == 0x01 and at + 4 + 2 * n <= size:
                    text, at = utf_16_le_decode(chunk[at + 4 : at + 4 + 2 * n], "replace", True)[0], at + 4 + 2 * n
            if text is not None:
                parts = (text,)
            else:
                parts, at = self._value(at, values, depth)
            if token != 0x06:
                stack[-1].children += parts or ()
            elif parts is not None:
                stack[-1].attributes[name] = text if text is not None else "".join(p if isinstance(p, str) else p.text() for p in parts)
        return top.children, at

    def _value(self, at: int, values: list | None, depth: int) -> tuple[list | None, int]:
        """A literal value or a substitution; None for one that is left out."""
        token = self._get("<B", at) & 0x0F
        if token == 0x05:
            kind = self._get("<B", at + 1)
            if kind != 0x01:
                raise BadXml(f"literal of type {kind:#x}")
            n = self._get("<H", at + 2)
            if at + 4 + 2 * n > len(self.chunk):
                raise BadXml("text is cut off")
            return [utf_16_le_decode(self.chunk[at + 4 : at + 4 + 2 * n], "replace", True)[0]], at + 4 + 2 * n
        if token not in (0x0D, 0x0E) or values is None:
            raise BadXml(f"no value at {at}")
        index, after = self._get("<H", at + 1), at + 4
        if index >= len(values):
            return None, after
        kind, start, size = values[index]
        if kind == 0x00 or (token == 0x0E and size == 0):
            return None, after
        if kind == 0x21:
            return self._nodes(start, start + size, None, depth + 1)[0], after
        return [value_text(kind, self.chunk[start : start + size])], after

    def _template(self, at: int, depth: int) -> tuple[list, int]:
        place = self._get("<I", at + 6)
        at += 10
        size = self._get("<I", place + 20)
        body = place + 24
        if place == at:
            at = body + size
        count = self._get("<I", at)
        if count > MOST_VALUES:
            raise BadXml("too many values")
        at += 4
        start = at + 4 * count
        values = []
        for i in range(count):
            length, kind = self._get("<H", at + 4 * i), self._get("<B", at + 4 * i + 2)
            if start + length > len(self.chunk):
                raise BadXml("values are cut off")
            values.append((kind, start, length))
            start += length
        return self._nodes(body, min(body + size, len(self.chunk)), values, depth + 1)[0], start


def projected(e: Element) -> str | dict:
    """An element as JSON knows it: its text, if that is all there is; else its children by name (a list where a
    name repeats), its attributes after an @, and its text, if any, as #text."""
    if not e.attributes and not e.elements():
        return e.text()
    out: dict[str, object] = {}
    for c in e.elements():
        out.setdefault(c.name, []).append(projected(c))
    out = {name: found[0] if len(found) == 1 else found for name, found in out.items()}
    out |= {f"@{k}": v for k, v in e.attributes.items()}
    return out | {"#text": e.text()} if e.text() else out


def leaves(tree: object, name: str = "", path: str = "") -> Iterator[tuple[str, str, str]]:
    """name, path and value of every string of a projected element (or any JSON), at any depth. Names in paths are
    joined by dots; items of a list have the name and path of the list."""
    if isinstance(tree, str):
        yield name, path, tree
    elif isinstance(tree, dict):
        for k, x in tree.items():
            yield from leaves(x, k, f"{path}.{k}" if path else k)
    elif isinstance(tree, list):
        for x in tree:
            yield from leaves(x, name, path)


#: What a payload may hold by its form alone, behind its header of four bytes: tokens of one byte, and open elements, whose
#: names stand within the chunk (an offset of 0 to CHUNK_END, little-endian).
_FORM = re.compile(rb"(?:[\x02-\x0F]|\x01.{5}(?:..\x00\x00|\x00\x00\x01\x00))*+", re.DOTALL)


def problem(payload: bytes) -> tuple[str, int] | None:
    """What is wrong with the form of a payload, and where: what stands behind the longest beginning of the right form."""
    if len(payload) < 4 or payload[0] != 0x0F:
        return ("TOO_SHORT", len(payload)) if len(payload) < 4 else ("INVALID_FRAGMENT_HEADER", 0)
    at = _FORM.match(payload, 4).end()
    rest = payload[at : at + 10]
    if rest[:1] in (b"", b"\x00"):
        return None
    return (("TRUNCATED" if len(rest) < 10 else "STRING_TABLE_OVERFLOW") if rest[0] == 0x01 else "UNKNOWN_OPCODE"), at


def flattened(event: Element) -> dict[str, str]:
    """The fields of EventData and UserData: named Data, unnamed ones as Data0, Data1 ..., other leaves by name."""
    out: dict[str, str] = {}
    unnamed = 0
    for part in ("EventData", "UserData"):
        section = event.child(part)
        todo = list(reversed(section.elements())) if section else []
        while todo:
            e = todo.pop()
            if e.elements():
                todo += reversed(e.elements())
            elif e.name == "Data" and "Name" in e.attributes:
                out[e.attributes["Name"]] = e.text()
            elif e.name == "Data":
                out[f"Data{unnamed}"] = e.text()
                unnamed += 1
            else:
                out[e.name] = e.text()
    return out


def envelope(event: Element) -> dict[str, object]:
    """What the System part says, by the names of the silver table."""
    system = event.child("System") or Element("System")
    first = {e.name: e for e in reversed(system.elements())}

    def text(name: str) -> str | None:
        return (first[name].text() or None) if name in first else None

    def attribute(name: str, key: str) -> str | None:
        return first[name].attributes.get(key) if name in first else None

    def number(x: str | None) -> int | None:
        return int(x) if x and x.lstrip("-").isdigit() else None

    return {
        "event_id": number(text("EventID")) or 0,
        "level": number(text("Level")),
        "channel": text("Channel"),
        "computer": text("Computer"),
        "provider": attribute("Provider", "Name"),
        "provider_guid": attribute("Provider", "Guid"),
        "user_sid": attribute("Security", "UserID"),
        "process_id": number(attribute("Execution", "ProcessID")),
        "thread_id": number(attribute("Execution", "ThreadID")),
    }


def encode(element: Element, at: int, names: list[int] | None = None, texts: list[int] | None = None) -> bytes:
    """A plain fragment (no template) for `element`, to stand at offset `at` of a chunk: for fixtures and tests. names and
    texts are given the places in it of what follows from `at`, and of all texts in order (attributes first)."""
    out = bytearray(b"\x0f\x01\x01\x00")

    def name(text: str) -> None:
        place = at + len(out) + 4
        if names is not None:
            names.append(len(out))
        out.extend(struct.pack("<IIHH", place, 0, 0, len(text)) + text.encode("utf-16-le") + b"\x00\x00")

    def literal(text: str) -> None:
        raw = text.encode("utf-16-le")
        out.extend(struct.pack("<BBH", 0x05, 0x01, len(raw) // 2))
        if texts is not None:
            texts.append(len(out))
        out.extend(raw)

    def put(e: Element) -> None:
        out.append(0x41 if e.attributes else 0x01)
        size_at = len(out)
        out.extend(b"\x00\x00\x00\x00")
        name(e.name)
        if e.attributes:
            out.extend(b"\x00\x00\x00\x00")
            for i, (k, v) in enumerate(e.attributes.items()):
                out.append(0x46 if i + 1 < len(e.attributes) else 0x06)
                name(k)
                literal(v)
        out.append(0x02)
        for c in e.children:
            literal(c) if isinstance(c, str) else put(c)
        out.append(0x04)
        struct.pack_into("<I", out, size_at, len(out) - size_at - 4)

    put(element)
    out.append(0x00)
    return bytes(out)


class Mold:
    """encode() and encode_template() for elements of one form, made by make(*values): what all with values of the same lengths
    have in common is encoded once. make puts each value into one text (or attribute), as it is."""

    def __init__(self, make: Callable[..., Element]) -> None:
        self.make, self.known, self.form, self.slots = make, {}, None, []

    def encode(self, values: tuple[str, ...], at: int) -> bytes:
        raws = [v.encode("utf-16-le") for v in values]
        sizes = tuple(map(len, raws))
        if sizes not in self.known:
            # Private characters, so each text shows whose it is.
            marks = [chr(0xE000 + i) * (n // 2) for i, n in enumerate(sizes)]
            names, texts = [], []
            plain = encode(self.make(*marks), 0, names, texts)
            at_text = [next((t for t in texts if plain.startswith(m.encode("utf-16-le"), t)), None) if m else 0 for m in marks]
            self.known[sizes] = plain, names, struct.unpack(f"<{len(names)}I", b"".join(plain[n : n + 4] for n in names)), at_text
        plain, names, places, at_text = self.known[sizes]
        out = bytearray(plain)
        for n, place in zip(names, places, strict=True):
            _INT.pack_into(out, n, place + at)
        for t, raw in zip(at_text, raws, strict=True):
            out[t : t + len(raw)] = raw
        return bytes(out)

    def encode_template(self, values: tuple[str, ...], at: int, known: dict[bytes, int]) -> bytes:
        if self.form is None:
            marks = [chr(0xE000 + i) for i in range(len(values))]
            own = {m.encode("utf-16-le"): i for i, m in enumerate(marks)}
            element = self.make(*marks)
            _template_body(element, 0, self.slots)
            self.slots, self.form = [own.get(raw, raw) for raw in self.slots], _form(element)
        if self.form not in known:
            return encode_template(self.make(*values), at, known)
        raws = [v.encode("utf-16-le") for v in values]
        return _filled(known[self.form], b"", [raws[s] if isinstance(s, int) else s for s in self.slots])


def encode_template(element: Element, at: int, known: dict[bytes, int]) -> bytes:
    """A fragment that fills a template with the texts and attributes of `element`, to stand at offset `at` of a
    chunk. known: where the templates of this chunk stand, by their form; a new one is written in place."""
    values: list[bytes] = []
    form = _form(element)
    place = known.get(form)
    if place is None:
        place = known[form] = at + len(_TEMPLATE) + 4
        body = _template_body(element, place + 24, values)
        definition = struct.pack("<I", 0) + bytes(16) + struct.pack("<I", len(body)) + body
    else:
        _template_body(element, 0, values)
        definition = b""
    return _filled(place, definition, values)


_TEMPLATE = b"\x0f\x01\x01\x00\x0c\x01" + bytes(4)


def _filled(place: int, definition: bytes, values: list[bytes]) -> bytes:
    items = b"".join([_ITEM.pack(len(v), 0x01, 0) for v in values])
    return _TEMPLATE + _INT.pack(place) + definition + _INT.pack(len(values)) + items + b"".join(values) + b"\x00"


def _form(e: Element) -> bytes:
    """Names and nesting, without the texts."""
    inner = b"".join(b"\x01" if isinstance(c, str) else _form(c) for c in e.children)
    return f"<{e.name}|{'|'.join(e.attributes)}>".encode() + inner + b"</>"


def _template_body(element: Element, at: int, values: list[bytes]) -> bytes:
    out = bytearray(b"\x0f\x01\x01\x00")

    def name(text: str) -> None:
        out.extend(struct.pack("<IIHH", at + len(out) + 4, 0, 0, len(text)) + text.encode("utf-16-le") + b"\x00\x00")

    def slot(text: str) -> None:
        out.extend(struct.pack("<BHB", 0x0D, len(values), 0x01))
        values.append(text.encode("utf-16-le"))

    def put(e: Element) -> None:
        out.append(0x41 if e.attributes else 0x01)
        out.extend(struct.pack("<H", 0xFFFF))
        size_at = len(out)
        out.extend(bytes(4))
        name(e.name)
        if e.attributes:
            out.extend(bytes(4))
            for i, (k, v) in enumerate(e.attributes.items()):
                out.append(0x46 if i + 1 < len(e.attributes) else 0x06)
                name(k)
                slot(v)
        out.append(0x02)
        for c in e.children:
            slot(c) if isinstance(c, str) else put(c)
        out.append(0x04)
        struct.pack_into("<I", out, size_at, len(out) - size_at - 4)

    put(element)
    out.append(0x00)
    return bytes(out)
