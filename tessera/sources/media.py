"""Media inside files and around prompts: images of office files, data URLs."""

from __future__ import annotations

import io
import mimetypes
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where packed formats keep their images, endings of images, most bytes of an image in a prompt.
MEDIA = {".docx": "word/media/", ".pptx": "ppt/media/", ".xlsx": "xl/media/", ".odt": "Pictures/", ".ods": "Pictures/", ".odp": "Pictures/", ".epub": ""}
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tif", ".tiff")
MOST_BYTES = 350_000

#: Figures of one file: name and content of each, in order.
Extract = Callable[[bytes], list[tuple[str, bytes]]]


def packed(prefix: str) -> Extract:
    """Images of a packed file below a folder."""

    def run(content: bytes) -> list[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(n, z.read(n)) for n in sorted(z.namelist()) if n.startswith(prefix) and n.lower().endswith(IMAGES)]

    return run


def figures(files: DataFrame, readers: dict[str, Extract] | None = None) -> DataFrame:
    """Figures of each file (path, content): path, number (from 1), name, image, error. ``readers`` adds formats by ending, such as a PDF library's; other files have none."""
    known = {**{end: packed(prefix) for end, prefix in MEDIA.items()}, **(readers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                read = known.get("." + path.rsplit(".", 1)[-1].lower())
                try:
                    out += [(path, k, name, image, None) for k, (name, image) in enumerate(read(content) if read and content else [], 1)]
                except Exception as e:  # noqa: BLE001  a broken file is a row with its error
                    out.append((path, 0, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "number", "name", "image", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, number int, name string, image binary, error string")


def mime_type(name: Column) -> Column:
    """Type of an image by its name's ending; JPEG for unknown ones."""
    end = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    out = F
    for k in IMAGES:
        out = out.when(end == k, mimetypes.types_map.get(k) or mimetypes.common_types.get(k) or "image/jpeg")
    return out.otherwise("image/jpeg")


def data_url(image: Column, name: Column, most: int = MOST_BYTES) -> Column:
    """An image as a data URL; null for an empty one, or one larger than ``most`` bytes, which needs to be made smaller first."""
    return F.when((F.length(image) > 0) & (F.length(image) <= most), F.concat(F.lit("data:"), mime_type(name), F.lit(";base64,"), F.base64(image)))


def smaller(images: DataFrame, shrink: Callable[[bytes, int], bytes | None], most: int = MOST_BYTES) -> DataFrame:
    """Images (id, name, image) that are at most ``most`` bytes: larger ones go through ``shrink``, an injected library, and become JPEGs; those it can't shrink are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            big = [x is not None and len(x) > most for x in b["image"]]
            yield pd.DataFrame({"id": b["id"], "name": [n + ".jpg" if g else n for n, g in zip(b["name"], big)], "image": [shrink(x, most) if g else x for x, g in zip(b["image"], big)]})

    return images.select("id", "name", "image").mapInPandas(run, "id long, name string, image binary")
