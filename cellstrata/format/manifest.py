"""Snapshot folders: a description, and regions with their store files."""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import md5

from cellstrata.format import storage
from cellstrata.format.errors import FormatError
from cellstrata.format.wire import decode_message, encode_message, last

# File names, and the snapshot types.
INFO, DATA, REGION = ".snapshotinfo", "data.manifest", "region-manifest."
TYPES = {0: "DISABLED", 1: "FLUSH", 2: "SKIPFLUSH"}
RANGES = {0: "TOP", 1: "BOTTOM"}


@dataclass
class Description:
    name: str
    table: str = ""
    creation_time: int = 0
    type: str = "FLUSH"
    version: int = 0
    owner: str = ""
    ttl: int = 0
    max_file_size: int = 0


@dataclass
class StoreFile:
    name: str
    file_size: int = 0
    split_key: bytes | None = None  # of a reference
    range: str | None = None


@dataclass
class Region:
    region_id: int  # unsigned
    namespace: bytes
    qualifier: bytes
    start_key: bytes = b""
    end_key: bytes = b""
    offline: bool = False
    split: bool = False
    replica_id: int = 0
    families: list[tuple[bytes, list[StoreFile]]] = field(default_factory=list)

    @property
    def table(self) -> bytes:
        return self.qualifier if self.namespace == b"default" else self.namespace + b":" + self.qualifier

    @property
    def folder(self) -> str:
        return md5(b",".join([self.table, self.start_key, str(self.region_id).encode()])).hexdigest()


@dataclass
class Family:
    name: bytes
    attributes: dict[str, str] = field(default_factory=dict)
    configuration: dict[str, str] = field(default_factory=dict)


@dataclass
class Schema:
    namespace: bytes
    qualifier: bytes
    attributes: dict[str, str] = field(default_factory=dict)
    families: list[Family] = field(default_factory=list)
    configuration: dict[str, str] = field(default_factory=dict)


@dataclass
class Manifest:
    description: Description
    schema: Schema | None
    regions: list[Region]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _text(m, n) -> str:
    return last(m, n, b"", bytes).decode("utf-8", "replace")


def _need(m, n, kind):
    if n not in m:
        raise FormatError(f"manifest field {n} is missing")
    return last(m, n, None, kind)


def _pairs(values) -> dict[str, str]:
    out = {}
    for v in values:
        m = decode_message(v)
        out[_text(m, 1)] = _text(m, 2)
    return out


def _description(b: bytes) -> Description:
    m = decode_message(b)
    return Description(
        _need(m, 1, bytes).decode("utf-8", "replace"), _text(m, 2), _signed(last(m, 3, 0, int)), TYPES.get(last(m, 4, 1, int), "FLUSH"), last(m, 5, 0, int), _text(m, 6), _signed(last(m, 8, 0, int)), _signed(last(m, 9, 0, int))
    )


def _table(b: bytes) -> tuple[bytes, bytes]:
    m = decode_message(b)
    return _need(m, 1, bytes), _need(m, 2, bytes)


def _region(b: bytes) -> Region:
    m = decode_message(b)
    info = decode_message(_need(m, 2, bytes))
    out = Region(_need(info, 1, int), *_table(_need(info, 2, bytes)), last(info, 3, b"", bytes), last(info, 4, b"", bytes), bool(last(info, 5, 0, int)), bool(last(info, 6, 0, int)), last(info, 7, 0, int))
    for f in m.get(3, []):
        family = decode_message(f)
        files = []
        for s in family.get(2, []):
            one = decode_message(s)
            file = StoreFile(_need(one, 1, bytes).decode("utf-8", "replace"), last(one, 3, 0, int))
            if 2 in one:
                ref = decode_message(last(one, 2, b"", bytes))
                file.split_key, file.range = _need(ref, 1, bytes), RANGES.get(_need(ref, 2, int))
            files.append(file)
        out.families.append((_need(family, 1, bytes), files))
    return out


def _schema(b: bytes) -> Schema:
    m = decode_message(b)
    ns, name = _table(last(m, 1, b"", bytes)) if 1 in m else (b"default", b"")
    out = Schema(ns, name, _pairs(m.get(2, [])), [], _pairs(m.get(4, [])))
    for f in m.get(3, []):
        one = decode_message(f)
        out.families.append(Family(_need(one, 1, bytes), _pairs(one.get(2, [])), _pairs(one.get(3, []))))
    return out


def read_manifest(folder: str) -> Manifest:
    """One manifest of all regions if there is one, else one file for each region and no schema."""
    info = storage.read_file(storage.join_path(folder, INFO))
    if info is None:
        raise FormatError(f"{folder} has no {INFO}")
    description = _description(info)
    whole = storage.read_file(storage.join_path(folder, DATA))
    if whole is not None:
        m = decode_message(whole)
        return Manifest(description, _schema(_need(m, 1, bytes)), [_region(r) for r in m.get(2, [])])
    names = [n for n in storage.list_dir(folder) if n.startswith(REGION)]
    return Manifest(description, None, [_region(storage.read_file(storage.join_path(folder, n))) for n in names])


def _table_message(ns: bytes, name: bytes) -> bytes:
    return encode_message([(1, ns), (2, name)])


def _region_message(r: Region) -> bytes:
    info = encode_message([(1, r.region_id), (2, _table_message(r.namespace, r.qualifier)), (3, r.start_key), (4, r.end_key), (5, int(r.offline)), (6, int(r.split)), (7, r.replica_id)])
    families = []
    for name, files in r.families:
        told = []
        for f in files:
            ref = None
            if f.split_key is not None:
                ref = encode_message([(1, f.split_key), (2, {v: k for k, v in RANGES.items()}[f.range])])
            told.append((2, encode_message([(1, f.name), (2, ref), (3, f.file_size)])))
        families.append((3, encode_message([(1, name), *told])))
    return encode_message([(1, 2), (2, info), *families])


def write_manifest(folder: str, manifest: Manifest, by_region: bool = False) -> None:
    d = manifest.description
    kinds = {v: k for k, v in TYPES.items()}
    storage.write_file(storage.join_path(folder, INFO), encode_message([(1, d.name), (2, d.table), (3, d.creation_time), (4, kinds[d.type]), (5, d.version), (6, d.owner), (8, d.ttl), (9, d.max_file_size)]))
    if by_region or manifest.schema is None:
        for r in manifest.regions:
            storage.write_file(storage.join_path(folder, REGION + r.folder), _region_message(r))
        return
    s = manifest.schema
    pairs = lambda n, d: [(n, encode_message([(1, k), (2, v)])) for k, v in d.items()]
    families = [(3, encode_message([(1, f.name), *pairs(2, f.attributes), *pairs(3, f.configuration)])) for f in s.families]
    schema = encode_message([(1, _table_message(s.namespace, s.qualifier)), *pairs(2, s.attributes), *families, *pairs(4, s.configuration)])
    storage.write_file(storage.join_path(folder, DATA), encode_message([(1, schema), *[(2, _region_message(r)) for r in manifest.regions]]))
