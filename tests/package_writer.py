"""Writes small content packages for the decoder tests."""

import struct


def i32(*values):
    return struct.pack(f"<{len(values)}i", *values)


def text(value):
    raw = value.encode() + b"\0" if value else b""
    return i32(len(raw)) + raw


class Package:
    def __init__(self, version=1009):
        self.version = version
        self.names = []
        self.imports = []
        self.exports = []
        self.soft = []

    def name(self, value):
        if value not in self.names:
            self.names.append(value)
        return i32(self.names.index(value), 0)

    def add_import(self, object_name, outer=0):
        none = self.name("None")
        self.imports.append(none + none + i32(outer) + self.name(object_name) + none + i32(0))
        return -len(self.imports)

    def add_export(self, class_name, body=b""):
        self.exports.append((self.add_import(class_name, outer=-1) if class_name else 0, body))

    def add_soft(self, package):
        self.soft.append(self.soft_path(package))

    def soft_path(self, package):
        return self.name(package) + self.name("None") + text("")

    # Properties in the layout with 64-bit sizes.
    def prop(self, name, kind, value, tag=b"", size=None):
        size = len(value) if size is None else size
        return self.name(name) + self.name(kind) + struct.pack("<q", size) + i32(0) + tag + value

    def end(self):
        return self.name("None")

    def struct_prop(self, name, inner):
        return self.prop(name, "StructProperty", inner, self.name("S") + bytes(16))

    def array_of_structs(self, name, elements):
        value = i32(len(elements)) + self.name("S") + bytes(16) + b"".join(elements)
        return self.prop(name, "ArrayProperty", value, self.name("StructProperty"))

    # Texture layout with 32-bit sizes and an id flag.
    def texture_enum(self, name, value):
        return self.name(name) + self.name("ByteProperty") + i32(8, 0) + self.name("E") + b"\0" + self.name(value)

    def build(self, magic=0x9E2A83C1, legacy=-8, name_count=None, wide_name=False):
        self.name("None")
        head_size = 0
        for _ in range(2):  # The second pass knows the header's size.
            names_at = head_size
            name_bytes = b"".join(text(n) + i32(0) for n in self.names)
            count = len(self.names)
            if wide_name:
                name_bytes += i32(-2) + "wx".encode("utf-16-le") + i32(0)
                count += 1
            soft_at = names_at + len(name_bytes)
            soft_bytes = b"".join(self.soft)
            imports_at = soft_at + len(soft_bytes)
            import_bytes = b"".join(self.imports)
            exports_at = imports_at + len(import_bytes)
            depends_at = exports_at + 96 * len(self.exports)
            body_at = depends_at + 4
            rows = b""
            for class_index, body in self.exports:
                row = i32(class_index) + bytes(24) + struct.pack("<qq", len(body), body_at)
                rows += row + bytes(96 - len(row))
                body_at += len(body)
            head = struct.pack("<I", magic) + i32(legacy, 0, 0, self.version, 0, 1) + bytes(20) + i32(0)
            head += text("Folder") + i32(0, count if name_count is None else name_count, names_at)
            if self.version >= 1008:
                head += i32(len(self.soft), soft_at)
            head += text("") + i32(0, 0, len(self.exports), exports_at, len(self.imports), imports_at, depends_at)
            head_size = len(head)
        return head + name_bytes + soft_bytes + import_bytes + rows + i32(0) + b"".join(b for _, b in self.exports)
