"""GLB scenes, STL triangle soups and checked tar.zst packages, as plain functions for use in UDFs over ``binaryFile`` frames."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import tarfile
from collections.abc import Iterator

import numpy as np
import zstandard

#: Fixed values of the GLB container: magic, version, chunk kinds; and the numpy types and widths of accessors.
GLB_MAGIC, GLB_VERSION, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 2, 0x4E4F534A, 0x004E4942
COMPONENTS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}


def glb_parts(data: bytes) -> tuple[dict, bytes]:
    """The JSON document and the binary chunk. Wrong framing, repeated and unknown chunks are errors."""
    if len(data) < 20 or struct.unpack_from("<III", data) != (GLB_MAGIC, GLB_VERSION, len(data)):
        raise ValueError("not a GLB of this length")
    found: dict[int, bytes] = {}
    view = memoryview(data)[12:]
    while view:
        size, kind = struct.unpack_from("<II", view)
        if size % 4 or size + 8 > len(view) or kind in found or kind not in (JSON_CHUNK, BIN_CHUNK):
            raise ValueError("bad GLB chunk")
        found[kind] = bytes(view[8 : 8 + size])
        view = view[8 + size :]
    return json.loads(found[JSON_CHUNK]), found.get(BIN_CHUNK, b"")


def glb_bytes(document: dict, binary: bytes = b"") -> bytes:
    text = json.dumps(document, separators=(",", ":"), allow_nan=False).encode()
    blocks = [(JSON_CHUNK, text + b" " * (-len(text) % 4))] + ([(BIN_CHUNK, binary + bytes(-len(binary) % 4))] if binary else [])
    body = b"".join(struct.pack("<II", len(b), k) + b for k, b in blocks)
    return struct.pack("<III", GLB_MAGIC, GLB_VERSION, 12 + len(body)) + body


def accessor(document: dict, binary: bytes, index: int) -> np.ndarray:
    """A strided view of the binary chunk; one that leaves its buffer view is an error."""
    a = document["accessors"][index]
    if "sparse" in a or "bufferView" not in a:
        raise ValueError("accessor without a plain buffer view")
    view = document["bufferViews"][a["bufferView"]]
    kind, width = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]]
    row = kind.itemsize * width
    stride, offset = view.get("byteStride", row), a.get("byteOffset", 0)
    if view.get("buffer", 0) or stride < row or offset + max(0, a["count"] - 1) * stride + row > view["byteLength"]:
        raise ValueError("accessor leaves its buffer view")
    out = np.ndarray((a["count"], width), kind, binary, view.get("byteOffset", 0) + offset, (stride, kind.itemsize))
    return out[:, 0] if width == 1 else out


STL = np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("extra", "<u2")])


def stl_triangles(data: bytes) -> np.ndarray:
    """n x 3 x 3 corners of a binary STL."""
    n = struct.unpack_from("<I", data, 80)[0]
    return np.frombuffer(data, STL, n, 84)["corner"].astype(np.float64)


def stl_bytes(corners: np.ndarray, title: bytes = b"") -> bytes:
    rows = np.zeros(len(corners), STL)
    rows["corner"] = corners
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    rows["normal"] = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-30)
    return title[:80].ljust(80, b"\0") + struct.pack("<I", len(rows)) + rows.tobytes()


def pack(members: dict[str, bytes], level: int = 3) -> bytes:
    """A deterministic tar.zst: members by name, no times or owners."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(members):
            if name.startswith("/") or "\\" in name or any(p in ("", ".", "..") for p in name.split("/")):
                raise ValueError(f"unsafe name {name!r}")
            info = tarfile.TarInfo(name)
            info.size = len(members[name])
            tar.addfile(info, io.BytesIO(members[name]))
    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress(out.getvalue())


def unpack(package: bytes, expected: dict[str, str]) -> Iterator[tuple[str, bytes]]:
    """Members whose SHA-256 is as expected; anything missing, repeated, unexpected, damaged or trailing is an error."""
    decoder = zstandard.ZstdDecompressor().decompressobj()
    data = decoder.decompress(package)
    if not decoder.eof or decoder.unused_data:
        raise ValueError("damaged or trailing frame")
    seen = set()
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for member in tar:
            body = tar.extractfile(member).read() if member.isfile() else b""
            if member.name in seen or expected.get(member.name) != hashlib.sha256(body).hexdigest():
                raise ValueError(f"unexpected member {member.name!r}")
            seen.add(member.name)
            yield member.name, body
    if seen != set(expected):
        raise ValueError("missing members")
