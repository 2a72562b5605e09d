"""Packing, certificates, and coordinates."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import engine_fingerprint
from ..sources import lexer

try:
    import zstandard
except ImportError:
    zstandard = None

def pack(raw: bytes, level: int = 9) -> bytes:
    if zstandard is None:
        raise RuntimeError("zstandard is not installed")
    return zstandard.ZstdCompressor(level=level, write_checksum=True).compress(raw)


def unpack(raw: bytes, most: int = 1 << 32) -> bytes:
    if zstandard is None:
        raise RuntimeError("zstandard is not installed")
    with zstandard.ZstdDecompressor().stream_reader(raw) as r:
        out = r.read(most + 1)
    if len(out) > most:
        raise lexer.DeliveryError("TooLarge", "unpacks to more than allowed")
    return out


def certificate(raw: bytes, counts: Mapping[str, int], edition: str, options: Mapping[str, object] | None = None) -> dict:
    """What a check found and of which bytes: hash, size, sections, tier counts, engine."""
    sections = [{"group": g, "start": a, "end": b} for g, a, b in lexer.byte_index(raw)]
    return {"version": 1, "sha256": hashlib.sha256(raw).hexdigest(), "size": len(raw), "groups": sections, "counts": dict(counts), "edition": edition, "engine": engine_fingerprint(), "options": dict(options or {})}


def revalidate_reasons(cert: dict | str | None, raw: bytes, edition: str, options: Mapping[str, object] | None = None) -> list[str]:
    """Why a certificate does not vouch for these bytes; empty if it does."""
    if cert is None:
        return ["missing"]
    try:
        cert = json.loads(cert) if isinstance(cert, str) else cert
        checks = [
            ("version", cert["version"] == 1), ("size", cert["size"] == len(raw)), ("content", cert["sha256"] == hashlib.sha256(raw).hexdigest()), ("edition", cert["edition"] == edition),
            ("engine", cert["engine"] == engine_fingerprint()), ("options", cert["options"] == dict(options or {})), ("errors", not cert["counts"].get("error")),
            ("index", [(s["group"], s["start"], s["end"]) for s in cert["groups"]] == lexer.byte_index(raw)),
        ]
    except (KeyError, TypeError, ValueError):
        return ["malformed"]
    return [name for name, good in checks if not good]


#: Ellipsoids, projections and datum shifts of the two grids (Airy ellipsoids to WGS84).
GRIDS = {
    "bng": {"a": 6377563.396, "b": 6356256.909, "f0": 0.9996012717, "lat0": 49.0, "lon0": -2.0, "n0": -100000.0, "e0": 400000.0, "t": (446.448, -125.157, 542.060), "s": -20.4894e-6, "r": (0.1502, 0.2470, 0.8421)},
    "irish": {"a": 6377340.189, "b": 6356034.447, "f0": 1.000035, "lat0": 53.5, "lon0": -8.0, "n0": 250000.0, "e0": 200000.0, "t": (482.530, -130.596, 564.557), "s": 8.150e-6, "r": (-1.042, -0.214, -0.631)},
}


def grid_to_wgs84(east: np.ndarray, north: np.ndarray, grid: str = "bng") -> tuple[np.ndarray, np.ndarray]:
    """(longitude, latitude): inverse transverse Mercator, then a seven-parameter shift. To some metres."""
    g = GRIDS[grid]
    a, b, f0 = g["a"], g["b"], g["f0"]
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    lat0, lon0 = math.radians(g["lat0"]), math.radians(g["lon0"])

    def arc(lat: np.ndarray) -> np.ndarray:
        d, s = lat - lat0, lat + lat0
        return b * f0 * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * np.sin(d) * np.cos(s) + (1.875 * (n**2 + n**3)) * np.sin(2 * d) * np.cos(2 * s) - 35 / 24 * n**3 * np.sin(3 * d) * np.cos(3 * s))

    lat = (north - g["n0"]) / (a * f0) + lat0
    for _ in range(4):
        lat = (north - g["n0"] - arc(lat)) / (a * f0) + lat
    v = a * f0 / np.sqrt(1 - e2 * np.power(np.sin(lat), 2))
    rho = a * f0 * (1 - e2) / np.power(1 - e2 * np.power(np.sin(lat), 2), 1.5)
    eta, tan, d = v / rho - 1, np.tan(lat), east - g["e0"]
    phi = lat - tan / (2 * rho * v) * d**2 + tan / (24 * rho * v**3) * (5 + 3 * tan**2 + eta - 9 * tan**2 * eta) * d**4 - tan / (720 * rho * v**5) * (61 + 90 * tan**2 + 45 * tan**4) * d**6
    sec = 1 / np.cos(lat)
    lam = lon0 + sec / v * d - sec / (6 * v**3) * (v / rho + 2 * tan**2) * d**3 + sec / (120 * v**5) * (5 + 28 * tan**2 + 24 * tan**4) * d**5 - sec / (5040 * v**7) * (61 + 662 * tan**2 + 1320 * tan**4 + 720 * tan**6) * d**7
    nu = a / np.sqrt(1 - e2 * np.power(np.sin(phi), 2))
    x, y, z = nu * np.cos(phi) * np.cos(lam), nu * np.cos(phi) * np.sin(lam), nu * (1 - e2) * np.sin(phi)
    rx, ry, rz = (math.radians(r / 3600) for r in g["r"])
    tx, ty, tz = g["t"]
    k = 1 + g["s"]
    x2, y2, z2 = tx + k * x - rz * y + ry * z, ty + rz * x + k * y - rx * z, tz - ry * x + rx * y + k * z
    wa, wb = 6378137.0, 6356752.314245
    we2 = 1 - wb * wb / (wa * wa)
    p = np.sqrt(x2 * x2 + y2 * y2)
    out = np.arctan2(z2, p * (1 - we2))
    for _ in range(3):
        out = np.arctan2(z2 + we2 * wa / np.sqrt(1 - we2 * np.power(np.sin(out), 2)) * np.sin(out), p)
    return np.degrees(np.arctan2(y2, x2)), np.degrees(out)


def to_wgs84(east: Column, north: Column, grid: str = "bng") -> tuple[Column, Column]:
    """(longitude, latitude) columns. In batches, for as one expression each step would repeat all before it."""

    @F.pandas_udf(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
    def both(e: pd.Series, n: pd.Series) -> pd.DataFrame:
        lon, lat = grid_to_wgs84(e.to_numpy(float), n.to_numpy(float), grid)
        return pd.DataFrame({"lon": lon, "lat": lat})

    at = both(east, north)
    return at["lon"], at["lat"]
