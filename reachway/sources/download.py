"""Idempotent downloads on the driver: a file that is there is kept; a failure is reported, not raised."""

from __future__ import annotations

import logging
import os
import shutil
import tempfile
import urllib.request
import zipfile
from pathlib import Path

log = logging.getLogger(__name__)
# Addresses of the public sources. The district polygons have no public address of their own: theirs is passed.
SOURCES = {
    "renipress": "http://datos.susalud.gob.pe/sites/default/files/RENIPRESS_2026_v6.csv",
    "centros_poblados_ign": "https://www.datosabiertos.gob.pe/sites/default/files/CCPP_0.zip",
    "poblacion_reniec": "https://www.datosabiertos.gob.pe/sites/default/files/BD_DAbiertos_16_OPP_2026_06.01.csv",
}
DISTRICT_FILES = ("cpg", "dbf", "prj", "shp", "shx")


def fetch(url: str, target: str | Path, force: bool = False, timeout: float = 60) -> bool:
    """Whether target is there afterwards. The file appears whole or not at all."""
    target = Path(target)
    if target.exists() and not force:
        return True
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=target.parent)
    try:
        with urllib.request.urlopen(url, timeout=timeout) as source, os.fdopen(handle, "wb") as out:
            shutil.copyfileobj(source, out)
        os.replace(part, target)
        return True
    except (OSError, ValueError) as e:
        log.warning("%s could not be fetched: %s", url, e)
        Path(part).unlink(missing_ok=True)
        return False


def unzip(archive: str | Path, folder: str | Path) -> Path:
    """Extracts once; members that would leave the folder are an error."""
    folder = Path(folder)
    if not folder.exists():
        with zipfile.ZipFile(archive) as z:
            root = folder.resolve()
            for name in z.namelist():
                if not (root / name).resolve().is_relative_to(root):
                    raise ValueError(f"{name} leaves the folder")
            part = folder.with_name(folder.name + ".part")
            shutil.rmtree(part, ignore_errors=True)
            z.extractall(part)
        part.rename(folder)
    return folder


def facilities_register(folder: str | Path, url: str = SOURCES["renipress"], force: bool = False) -> bool:
    return fetch(url, Path(folder) / "renipress.csv", force)


def settlement_points(folder: str | Path, url: str = SOURCES["centros_poblados_ign"], force: bool = False) -> bool:
    """The archive, and the shapefile in a folder beside it."""
    archive, target = Path(folder) / "centros_poblados_ign.zip", Path(folder) / "centros_poblados_ign"
    if not fetch(url, archive, force):
        return False
    if force:
        shutil.rmtree(target, ignore_errors=True)
    unzip(archive, target)
    return True


def district_population_table(folder: str | Path, url: str = SOURCES["poblacion_reniec"], force: bool = False) -> bool:
    return fetch(url, Path(folder) / "poblacion_reniec.csv", force)


def district_polygons(folder: str | Path, url: str | None, force: bool = False) -> bool:
    """The files of the polygon layer; url: their common address without the ending. They are there once all are."""
    stem = Path(folder) / "distritos_inei" / "DISTRITOS"
    if url is None:
        return stem.with_suffix(".shp").exists()
    return all([fetch(f"{url}.{ending}", stem.with_suffix(f".{ending}"), force) for ending in DISTRICT_FILES])


def all_sources(folder: str | Path, urls: dict[str, str] | None = None, force: bool = False) -> dict[str, bool]:
    """Which of the four sources are there afterwards, by name."""
    urls = SOURCES | (urls or {})
    return {
        "renipress": facilities_register(folder, urls["renipress"], force), "centros_poblados_ign": settlement_points(folder, urls["centros_poblados_ign"], force),
        "poblacion_reniec": district_population_table(folder, urls["poblacion_reniec"], force), "distritos_inei": district_polygons(folder, urls.get("distritos_inei"), force),
    }
