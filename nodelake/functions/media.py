"""Media types, their short names, and the registry of serializers."""

from __future__ import annotations

from collections.abc import Callable

from nodelake.errors import Unsupported

# Media types and encodings of the wire format.
OCTET_STREAM = "application/octet-stream"
JSON = "application/json"
JSON_SEQ = "application/json-seq"
MSGPACK = "application/x-msgpack"
CSV = "text/csv"
PLAIN = "text/plain"
HTML = "text/html"
ARROW_FILE = "application/vnd.apache.arrow.file"
PARQUET = "application/x-parquet"
HDF5 = "application/x-hdf5"
TIFF = "image/tiff"
PNG = "image/png"
EXCEL = "application/vnd.ms-excel"
ZIP = "application/zip"
NETCDF = "application/x-netcdf4"
ZARR = "application/x-zarr"
ENCODINGS = ("gzip", "zstd", "lz4", "blosc2")

# File extensions by media type.
EXTENSIONS = {
    HDF5: ("h5", "hdf5", "hdf"),
    PARQUET: ("parquet", "pq"),
    ARROW_FILE: ("arrow", "feather", "ipc"),
    CSV: ("csv",),
    JSON: ("json",),
    TIFF: ("tif", "tiff"),
    PNG: ("png",),
    EXCEL: ("xlsx", "xls"),
    NETCDF: ("nc", "nc4"),
    ZARR: ("zarr",),
    MSGPACK: ("msgpack",),
    PLAIN: ("txt", "text"),
}
_BY_EXTENSION = {x: mime for mime, names in EXTENSIONS.items() for x in names}
#: What a family is written as where the request names nothing known.
DEFAULTS = {"array": OCTET_STREAM, "sparse": OCTET_STREAM, "table": ARROW_FILE}


def of_extension(extension: str) -> str | None:
    return _BY_EXTENSION.get(extension.lstrip(".").lower())


class Registry:
    """Serializers by (family, media type), and short names by family."""

    def __init__(self):
        self._by_key: dict[tuple[str, str], Callable] = {}
        self._aliases: dict[str, dict[str, str]] = {}

    def register(self, family: str, media_type: str, serializer: Callable) -> None:
        self._by_key[family, media_type] = serializer

    def register_alias(self, family: str, alias: str, media_type: str) -> None:
        self._aliases.setdefault(family, {})[alias] = media_type

    def dispatch(self, family: str, media_type: str) -> Callable:
        if (family, media_type) not in self._by_key:
            raise Unsupported(f"no serializer of {family} to {media_type}")
        return self._by_key[family, media_type]

    def media_types(self, family: str) -> list[str]:
        return sorted(m for f, m in self._by_key if f == family)

    def formats(self) -> dict[str, list[str]]:
        return {f: self.media_types(f) for f in sorted({f for f, _ in self._by_key})}

    def aliases(self) -> dict[str, dict[str, list[str]]]:
        out: dict[str, dict[str, list[str]]] = {}
        for family, own in self._aliases.items():
            for alias, media_type in sorted(own.items()):
                out.setdefault(family, {}).setdefault(media_type, []).append(alias)
        return out

    def resolve_alias(self, family: str, name: str) -> str:
        return self._aliases.get(family, {}).get(name) or of_extension(name) or name

    def negotiate(self, family: str, accept: str | None) -> str | None:
        """The first accepted type that is registered or ``*/*``, which is the family's default, as is no match.

        Weights are not read.
        """
        for part in (accept or "").split(","):
            wanted = part.split(";")[0].strip()
            if wanted == "*/*":
                break
            if (family, wanted) in self._by_key:
                return wanted
        return DEFAULTS.get(family)
