"""Reads the tables of one content package. A helper for the decode job, run inside tasks.

It only turns bytes into nested rows; what the rows mean is decided by Spark expressions in
`stowage.sources.packages`.
"""

from __future__ import annotations

import struct

# Fixed values of the format: magic number, accepted version, version that added soft paths,
# bytes per import entry, nesting limit, and bytes of type-specific tag data per property.
MAGIC = 0x9E2A83C1
LEGACY_VERSION = -8
SOFT_PATHS_SINCE = 1008
IMPORT_BYTES = 40
MAX_NESTING = 6
TAG_BYTES = {
    "BoolProperty": 1,
    "StructProperty": 24,
    "ArrayProperty": 8,
    "SetProperty": 8,
    "ByteProperty": 8,
    "EnumProperty": 8,
    "MapProperty": 16,
}
SOFT_TYPES = ("SoftObjectProperty", "SoftClassProperty")
LIST_TYPES = ("ArrayProperty", "SetProperty")
ENUM_TYPES = ("ByteProperty", "EnumProperty")
TEXTURE_CLASSES = ("Texture2D", "TextureCube", "Texture2DArray", "VolumeTexture")


class Rejected(Exception):
    """The package cannot be read; the text is the quarantine reason."""


class Ended(Rejected):
    def __init__(self):
        super().__init__("unexpected end of file")


class Bytes:
    def __init__(self, data: bytes, at: int = 0, names: list[str] | None = None):
        self.data, self.at, self.names = data, at, names or []

    def number(self, code: str = "<i") -> int:
        end = self.at + struct.calcsize(code)
        if end > len(self.data):
            raise Ended
        value = struct.unpack_from(code, self.data, self.at)[0]
        self.at = end
        return value

    def skip(self, count: int) -> None:
        if self.at + count > len(self.data):
            raise Ended
        self.at += count

    def seek_past(self, position: int) -> None:
        self.at = max(self.at, position)

    def skip_text(self) -> None:
        length = self.number()
        self.skip(length if length >= 0 else -2 * length)

    def name(self) -> str | None:
        """Name reference: table index and an instance number."""
        index = self.number()
        self.number()
        return self.names[index] if 0 <= index < len(self.names) else None

    def required_name(self) -> str:
        name = self.name()
        if name is None:
            raise Ended
        return name


def _not_negative(cursor: Bytes, what: str) -> int:
    value = cursor.number()
    if value < 0:
        raise Rejected(f"invalid data: negative {what}")
    return value


def read_summary(data: bytes) -> dict[str, int]:
    c = Bytes(data)
    magic = c.number("<I")
    if magic != MAGIC:
        raise Rejected(f"invalid magic number: 0x{magic:08x}")
    legacy = c.number()
    if legacy != LEGACY_VERSION:
        raise Rejected(f"unsupported file version: legacy={legacy}, ue5=0")
    c.skip(8)
    version = c.number()
    if version <= 0:
        raise Rejected(f"unsupported file version: legacy={legacy}, ue5={version & 0xFFFFFFFF}")
    c.number()
    custom_versions = c.number()
    if custom_versions < 0:
        raise Ended
    c.at += custom_versions * 20
    c.number()
    c.skip_text()
    c.number()
    out = {"name_count": _not_negative(c, "name_count"), "name_offset": _not_negative(c, "name_offset")}
    out["soft_count"] = out["soft_offset"] = 0
    if version >= SOFT_PATHS_SINCE:
        out["soft_count"], out["soft_offset"] = c.number(), c.number()
        if min(out["soft_count"], out["soft_offset"]) < 0:
            raise Rejected("invalid data: negative soft_object_path count or offset")
    c.skip_text()
    c.skip(8)
    for what in ("export_count", "export_offset", "import_count", "import_offset", "depends_offset"):
        out[what] = _not_negative(c, what)
    return out


def read_names(data: bytes, count: int, offset: int) -> list[str]:
    c, names = Bytes(data, offset), []
    for _ in range(count):
        length = c.number()
        if length > 0:
            start = c.at
            c.skip(length)
            raw = data[start : c.at]
            names.append((raw[:-1] if raw.endswith(b"\0") else raw).decode("utf-8", "replace"))
        else:
            # Wide-character names are not kept, but hold their place.
            c.at += -2 * length
            names.append("")
        c.skip(4)
    return names


def read_imports(data: bytes, names: list[str], count: int, offset: int) -> list[dict]:
    c, out = Bytes(data, offset, names), []
    for _ in range(count):
        start = c.at
        c.skip(IMPORT_BYTES)
        inner = Bytes(data, start + 16, names)
        out.append({"outer": inner.number(), "object_name": inner.name()})
    return out


def read_soft_packages(data: bytes, names: list[str], count: int, offset: int) -> list[str | None]:
    c, out = Bytes(data, offset, names), []
    for _ in range(count):
        out.append(_soft_path(c))
    return out


def _soft_path(c: Bytes) -> str | None:
    package = c.name()
    c.skip(8)
    c.skip_text()
    return package


def read_exports(data: bytes, imports: list[dict], summary: dict[str, int]) -> tuple[list[dict], bool]:
    """Export entries that lie inside the file, and whether some do not."""
    count, offset = summary["export_count"], summary["export_offset"]
    if count == 0 or summary["depends_offset"] <= offset:
        return [], False
    stride = (summary["depends_offset"] - offset) // count
    if stride < 4:
        return [], False
    out = []
    for index in range(count):
        at = offset + index * stride
        if at + 4 > len(data):
            return out, True
        class_index = struct.unpack_from("<i", data, at)[0]
        slot = -class_index - 1
        entry = {"class_name": imports[slot]["object_name"] if 0 <= slot < len(imports) else None}
        # Entries too short for, or cut before, their body location have none.
        if stride >= 44 and at + 44 <= len(data):
            entry["size"], entry["offset"] = struct.unpack_from("<qq", data, at + 28)
        out.append(entry)
    return out, False


def _body(data: bytes, export: dict) -> bytes | None:
    size, offset = export.get("size", 0), export.get("offset", 0)
    inside = size > 0 and offset > 0 and offset + size <= len(data)
    return data[offset : offset + size] if inside else None


def _text_value(c: Bytes) -> str | None:
    length = c.number()
    if length < 0:
        c.skip(-2 * length)
        return None
    start = c.at
    c.skip(length)
    try:
        return c.data[start : max(c.at - 1, start)].decode("utf-8")
    except UnicodeDecodeError:
        return None


def walk_properties(c: Bytes, found: list[dict], nested: bool, depth: int = 0) -> None:
    """One property stream up to its end mark; keeps values that can name a package.

    Flat streams step over structs and lists, nested ones go into them. A broken inner stream
    ends that stream only.
    """

    def keep(kind: str, value: str | None) -> None:
        if value is not None:
            found.append({"name": name, "type": kind, "value": value, "depth": depth})

    while (name := c.required_name()) != "None":
        kind = c.required_name()
        size = max(c.number("<q"), 0)
        c.number()
        tag_start = c.at
        deeper = nested and depth < MAX_NESTING
        if kind in SOFT_TYPES:
            keep(kind, _soft_path(c))
        elif kind == "StrProperty":
            keep(kind, _text_value(c))
        elif kind == "NameProperty":
            keep(kind, c.name())
        elif nested and kind in LIST_TYPES:
            element = c.name()
            end = c.at + size
            if deeper and element in ("StructProperty", *SOFT_TYPES):
                _walk_list(c, found, element, end, keep, depth)
            c.seek_past(end)
        elif deeper and kind == "StructProperty":
            c.skip(TAG_BYTES[kind])
            end = c.at + size
            _walk_inner(c, found, depth)
            c.seek_past(end)
        else:
            c.skip(TAG_BYTES.get(kind, 0))
            c.skip(size)
        if nested:
            c.seek_past(tag_start + size)


def _walk_inner(c: Bytes, found: list[dict], depth: int) -> None:
    try:
        walk_properties(c, found, True, depth + 1)
    except Ended:
        pass


def _walk_list(c: Bytes, found: list[dict], element: str, end: int, keep, depth: int) -> None:
    left = c.number() & 0xFFFFFFFF
    if element == "StructProperty":
        c.skip(TAG_BYTES[element])
    while left and c.at < end:
        before = c.at
        if element == "StructProperty":
            _walk_inner(c, found, depth)
        else:
            keep(element, _soft_path(c))
        if c.at == before:
            break
        left -= 1


def walk_texture(c: Bytes, found: list[dict]) -> None:
    """Texture streams use another layout: 32-bit sizes and an optional id per property."""
    while (name := c.required_name()) != "None":
        kind = c.required_name()
        size = c.number()
        c.number()
        c.skip(TAG_BYTES.get(kind, 0))
        if c.number("<B"):
            c.skip(16)
        if kind in ENUM_TYPES and size == 8:
            found.append({"name": name, "type": kind, "value": c.name(), "depth": 0})
        elif kind != "BoolProperty":
            c.skip(max(size, 0))


def _walk_table(c: Bytes, found: list[dict]) -> None:
    """A table's own properties, which do not count, then one stream per row."""
    walk_properties(c, [], nested=False)
    for _ in range(max(c.number(), 0)):
        c.skip(8)
        walk_properties(c, found, nested=False)


def read_properties(data: bytes, names: list[str], exports: list[dict]) -> list[dict]:
    """Streams worth reading: the first table, montage and texture, and all of a sequence's."""
    classes = [e["class_name"] for e in exports]
    out: list[dict] = []

    def read(section: str, export: dict, walk) -> None:
        body = _body(data, export)
        found: list[dict] = []
        if body is not None:
            try:
                walk(Bytes(body, 0, names), found)
            except Ended:
                pass  # What was found before a broken property stays.
        out.extend({"section": section, **row} for row in found)

    def first(section: str, wanted: tuple[str, ...], walk) -> None:
        hit = next((e for e in exports if "size" in e and e["class_name"] in wanted), None)
        if hit is not None:
            read(section, hit, walk)

    nested = lambda c, found: walk_properties(c, found, nested=True)
    first("table", ("DataTable",), _walk_table)
    first("montage", ("AnimMontage",), nested)
    first("texture", TEXTURE_CLASSES, walk_texture)
    if "LevelSequence" in classes:
        for export in exports:
            read("sequence", export, nested)
    return out


def read_package(data: bytes, is_map: bool) -> dict:
    """All tables of a package as one nested row; raises `Rejected` with the reason."""
    summary = read_summary(data)
    names = read_names(data, summary["name_count"], summary["name_offset"])
    imports = read_imports(data, names, summary["import_count"], summary["import_offset"])
    soft = read_soft_packages(data, names, summary["soft_count"], summary["soft_offset"])
    exports, cut = read_exports(data, imports, summary)
    return {
        "imports": imports,
        "soft_packages": [p for p in soft if p is not None],
        "export_classes": [e["class_name"] for e in exports],
        "exports_cut": cut,
        "mentions_tick": "ReceiveTick" in names,
        "properties": [] if is_map else read_properties(data, names, exports),
    }
