"""Files in the shared folder, reached by executors through whichever file system the folder's address names."""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

import numpy as np
from pyarrow import fs as pafs


#: Schemes that Hadoop and this library call differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a full address (`common.qualified`). Paths are meant letter by letter, as Hadoop
    reads them: blanks and percent signs are themselves."""
    scheme, rest = uri.split(":", 1)
    host = re.match("(//[^/]*)?", rest)[0]
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{host}{quote(rest[len(host):], safe='/:')}")


def publish(uri: str, chunks) -> None:
    """Writes a file under another name and moves it into place, so that a repeated or broken task leaves no half file."""
    fs, path = opened(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        for c in chunks:
            out.write(c)
    try:
        fs.move(draft, path)
    except OSError:  # file systems that don't replace: another attempt of the task was first, with the same bytes
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(draft)


def read(uri: str, at: int = 0, size: int | None = None) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        f.seek(at)
        return f.read() if size is None else f.read(size)


class ByteLevel:
    """A byte-level vocabulary's encoder. Ids equal the tokenizers library's (tests hold them against it); the ranks file
    of the same vocabulary is read, as its engine takes a quarter of the time."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not any(s in text for s in self.special):
            return self.own.encode_ordinary(text)
        return [i for p in self.cut.split(text) for i in ([self.special[p]] if p in self.special else self.own.encode_ordinary(p))]


def special_tokens(path: str) -> dict[str, int]:
    """The special tokens of a tokenizer's JSON file, and their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


_LOADED: dict[tuple, ByteLevel] = {}


def byte_level(path: str, pattern: str, special: dict[str, int]) -> ByteLevel:
    key = (path, pattern, *special.items())
    if key not in _LOADED:
        _LOADED[key] = ByteLevel(path, pattern, special)
    return _LOADED[key]


def width(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
