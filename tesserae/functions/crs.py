"""Coordinate systems to WGS84 longitude and latitude, in closed form: by code, or by the parameters in a WKT text.

Codes that are not in the tables can be registered. Projected coordinates are easting first, as files have them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

Point = tuple[float, float]
Transform = Callable[[float, float], Point]


class UnknownCRS(ValueError):
    """No transform for this coordinate system."""


_REGISTRY: dict[str, Transform] = {}

#: Semi-major axis and flattening of the ellipsoids.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 1 / 298.257223563),
    "GRS80": (6378137.0, 1 / 298.257222101),
    "Bessel": (6377397.155, 1 / 299.1528128),
    "Airy": (6377563.396, 1 / 299.3249646),
    "Intl": (6378388.0, 1 / 297.0),
    "Clarke66": (6378206.4, 1 / 294.978698214),
    "Clarke80IGN": (6378249.2, 1 / 293.466021294),
    "Krass": (6378245.0, 1 / 298.3),
    "AusNat": (6378160.0, 1 / 298.25),
}
WGS84, GRS80, BESSEL = (ELLIPSOIDS[n] for n in ("WGS84", "GRS80", "Bessel"))
#: Datums to WGS84; metres, arc seconds, parts per million (position vector).
DHDN = (612.4, 77.0, 440.2, -0.054, 0.057, -2.797, 2.55)
OSGB = (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894)
RD = (565.4171, 50.3319, 465.5524, -0.398957, 0.343988, -1.87740, 4.0725)
CH1903 = (674.374, 15.056, 405.346, 0, 0, 0, 0)
SJTSK = (570.8, 85.7, 462.8, 4.998, 1.587, 5.261, 3.56)
MGI = (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232)
ED50 = (-87.0, -98.0, -121.0, 0, 0, 0, 0)
BD72 = (-106.8686, 52.2978, -103.7239, 0.3366, -0.457, 1.8422, -1.2747)
MONTE_MARIO = (-104.1, -49.1, -9.9, 0.971, -2.917, 0.714, -11.68)
TM65 = (482.5, -130.6, 564.6, -1.042, -0.214, -0.631, 8.15)
NTF = (-168.0, -60.0, 320.0, 0, 0, 0, 0)
PULKOVO = (23.92, -141.27, -80.9, 0, 0.35, 0.82, -0.12)
#: The parameters of projected systems: method, ellipsoid, datum, and what the method takes, in degrees and metres.
SYSTEMS: dict[int, tuple] = {
    27700: ("tm", "Airy", OSGB, dict(lat0=49, lon0=-2, k0=0.9996012717, fe=400_000, fn=-100_000)),
    29902: ("tm", "Airy", TM65, dict(lat0=53.5, lon0=-8, k0=1.000035, fe=200_000, fn=250_000)),
    2157: ("tm", "GRS80", None, dict(lat0=53.5, lon0=-8, k0=0.99982, fe=600_000, fn=750_000)),
    2180: ("tm", "GRS80", None, dict(lat0=0, lon0=19, k0=0.9993, fe=500_000, fn=-5_300_000)),
    3006: ("tm", "GRS80", None, dict(lat0=0, lon0=15, k0=0.9996, fe=500_000, fn=0)),
    3067: ("tm", "GRS80", None, dict(lat0=0, lon0=27, k0=0.9996, fe=500_000, fn=0)),
    3301: ("lcc", "GRS80", None, dict(lat0=57.51755393, lon0=24, lat1=59 + 1 / 3, lat2=58, fe=500_000, fn=6_375_000)),
    3346: ("tm", "GRS80", None, dict(lat0=0, lon0=24, k0=0.9998, fe=500_000, fn=0)),
    3059: ("tm", "GRS80", None, dict(lat0=0, lon0=24, k0=0.9996, fe=500_000, fn=-6_000_000)),
    3763: ("tm", "GRS80", None, dict(lat0=39.66825833333333, lon0=-8.133108333333334, k0=1, fe=0, fn=0)),
    2100: ("tm", "GRS80", (-199.87, 74.79, 246.62, 0, 0, 0, 0), dict(lat0=0, lon0=24, k0=0.9996, fe=500_000, fn=0)),
    3003: ("tm", "Intl", MONTE_MARIO, dict(lat0=0, lon0=9, k0=0.9996, fe=1_500_000, fn=0)),
    3004: ("tm", "Intl", MONTE_MARIO, dict(lat0=0, lon0=15, k0=0.9996, fe=2_520_000, fn=0)),
    2193: ("tm", "GRS80", None, dict(lat0=0, lon0=173, k0=0.9996, fe=1_600_000, fn=10_000_000)),
    23700: ("somerc", "GRS80", (52.17, -71.82, -14.9, 0, 0, 0, 0), dict(lat0=47.14439372222222, lon0=19.04857177777778, k0=0.99993, fe=650_000, fn=200_000)),
    2154: ("lcc", "GRS80", None, dict(lat0=46.5, lon0=3, lat1=49, lat2=44, fe=700_000, fn=6_600_000)),
    27572: ("lcc", "Clarke80IGN", NTF, dict(lat0=46.8, lon0=2.33722917, lat1=46.8, k0=0.99987742, fe=600_000, fn=2_200_000)),
    3034: ("lcc", "GRS80", None, dict(lat0=52, lon0=10, lat1=35, lat2=65, fe=4_000_000, fn=2_800_000)),
    3812: ("lcc", "GRS80", None, dict(lat0=50.797815, lon0=4.359215833333333, lat1=49 + 5 / 6, lat2=51 + 1 / 6, fe=649_328, fn=665_262)),
    31370: ("lcc", "Intl", BD72, dict(lat0=90, lon0=4.367486666666666, lat1=51.16666723333333, lat2=49.8333339, fe=150_000.013, fn=5_400_088.438)),
    31287: ("lcc", "Bessel", MGI, dict(lat0=47.5, lon0=13 + 1 / 3, lat1=49, lat2=46, fe=400_000, fn=400_000)),
    5243: ("lcc", "GRS80", None, dict(lat0=51, lon0=10.5, lat1=48 + 2 / 3, lat2=53 + 2 / 3, fe=0, fn=0)),
    3978: ("lcc", "GRS80", None, dict(lat0=49, lon0=-95, lat1=49, lat2=77, fe=0, fn=0)),
    3035: ("laea", "GRS80", None, dict(lat0=52, lon0=10, fe=4_321_000, fn=3_210_000)),
    28992: ("sterea", "Bessel", RD, dict(lat0=52.15616055555555, lon0=5.38763888888889, k0=0.9999079, fe=155_000, fn=463_000)),
    2056: ("somerc", "Bessel", CH1903, dict(lat0=46.95240555555556, lon0=7.439583333333333, k0=1, fe=2_600_000, fn=1_200_000)),
    21781: ("somerc", "Bessel", CH1903, dict(lat0=46.95240555555556, lon0=7.439583333333333, k0=1, fe=600_000, fn=200_000)),
    5514: ("krovak", "Bessel", SJTSK, {}),
}
SYSTEMS[7415] = SYSTEMS[28992]  # with heights
SYSTEMS |= {31254 + i: ("tm", "Bessel", MGI, dict(lat0=0, lon0=10 + 1 / 3 + 3 * i, k0=1, fe=0, fn=-5_000_000)) for i in range(3)}
SYSTEMS |= {31257 + i: ("tm", "Bessel", MGI, dict(lat0=0, lon0=10 + 1 / 3 + 3 * i, k0=1, fe=150_000 + 300_000 * i, fn=-5_000_000)) for i in range(3)}


def inverse_mercator(x: float, y: float, ell: tuple, lon0: float, k0: float, fe: float, lat0: float = 0.0, fn: float = 0.0) -> Point:
    """Transverse Mercator to degrees, by the Krueger series to third order in n."""
    a, f = ell
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi, eta = (y - fn) / (k0 * big), (x - fe) / (k0 * big)
    if lat0:  # the northing of the origin
        e, ph = math.sqrt(f * (2 - f)), math.radians(lat0)
        chi = math.atan(math.sinh(math.asinh(math.tan(ph)) - e * math.atanh(e * math.sin(ph))))
        alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        xi += chi + sum(c * math.sin(2 * j * chi) for j, c in enumerate(alpha, 1))
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi2 = xi - sum(b * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    eta2 = eta - sum(b * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = math.asin(math.sin(xi2) / math.cosh(eta2))
    lat = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return math.degrees(math.radians(lon0) + math.atan2(math.sinh(eta2), math.cos(xi2))), math.degrees(lat)


def _isometric(lat: float, e: float) -> float:
    """Isometric latitude, of radians."""
    return math.asinh(math.tan(lat)) - e * math.atanh(e * math.sin(lat))


def _from_isometric(psi: float, e: float) -> float:
    lat = math.atan(math.sinh(psi))
    for _ in range(12):
        lat = math.atan(math.sinh(psi + e * math.atanh(e * math.sin(lat))))
    return lat


def inverse_lambert(x: float, y: float, ell: tuple, lat0: float, lon0: float, lat1: float, fe: float, fn: float, lat2: float | None = None, k0: float = 1.0) -> Point:
    """Conformal conic with one or two standard parallels."""
    a, f = ell
    e = math.sqrt(f * (2 - f))
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat1 if lat2 is None else lat2))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    n = math.sin(p1) if p1 == p2 else math.log(m(p2) / m(p1)) / (_isometric(p1, e) - _isometric(p2, e))
    big = a * k0 * m(p1) / n * math.exp(n * _isometric(p1, e))
    r0 = 0.0 if lat0 == 90 else big * math.exp(-n * _isometric(p0, e))
    dx, dy = x - fe, r0 - (y - fn)
    r = math.copysign(math.hypot(dx, dy), n)
    theta = math.atan2(math.copysign(1, n) * dx, math.copysign(1, n) * dy)
    return lon0 + math.degrees(theta / n), math.degrees(_from_isometric(math.log(big / r) / n, e))


def inverse_equal_area(x: float, y: float, ell: tuple, lat0: float, lon0: float, fe: float, fn: float) -> Point:
    """Azimuthal equal area, oblique."""
    a, f = ell
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)
    qp, s0 = q(1.0), math.sin(math.radians(lat0))
    b0, rq = math.asin(q(s0) / qp), a * math.sqrt(qp / 2)
    d = a * math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * s0 * s0) / (rq * math.cos(b0))
    dx, dy = (x - fe) / d, (y - fn) * d
    rho = math.hypot(dx, dy)
    if not rho:
        return lon0, lat0
    c = 2 * math.asin(rho / (2 * rq))
    b = math.asin(math.cos(c) * math.sin(b0) + dy * math.sin(c) * math.cos(b0) / rho)
    lon = math.atan2(dx * math.sin(c), rho * math.cos(b0) * math.cos(c) - dy * math.sin(b0) * math.sin(c))
    lat, want = b, qp * math.sin(b)
    for _ in range(12):  # Newton's rule for the latitude with that area below it
        s = math.sin(lat)
        lat += (want - q(s)) * (1 - e2 * s * s) ** 2 / (2 * (1 - e2) * math.cos(lat))
    return lon0 + math.degrees(lon), math.degrees(lat)


def _sphere(ell: tuple, lat0: float) -> tuple[float, float, float, float, float]:
    """The conformal sphere that touches an ellipsoid at a latitude: exponent, constant, latitude there, radius, eccentricity."""
    a, f = ell
    e2, p = f * (2 - f), math.radians(lat0)
    e = math.sqrt(e2)
    n = math.sqrt(1 + e2 * math.cos(p) ** 4 / (1 - e2))
    chi = math.asin(math.sin(p) / n)
    c = math.asinh(math.tan(chi)) - n * _isometric(p, e)
    return n, c, chi, a * math.sqrt(1 - e2) / (1 - e2 * math.sin(p) ** 2), e


def inverse_stereographic(x: float, y: float, ell: tuple, lat0: float, lon0: float, k0: float, fe: float, fn: float) -> Point:
    """Oblique stereographic: over a conformal sphere."""
    a, f = ell
    e2, p = f * (2 - f), math.radians(lat0)
    n, _, _, r, e = _sphere(ell, lat0)
    s1, s2 = (1 + math.sin(p)) / (1 - math.sin(p)), (1 - e * math.sin(p)) / (1 + e * math.sin(p))
    w1 = (s1 * s2**e) ** n
    c = (n + math.sin(p)) * (1 - (w1 - 1) / (w1 + 1)) / ((n - math.sin(p)) * (1 + (w1 - 1) / (w1 + 1)))
    chi0 = math.asin((c * w1 - 1) / (c * w1 + 1))
    dx, dy = x - fe, y - fn
    rho = math.hypot(dx, dy)
    if not rho:
        return lon0, lat0
    far = 2 * math.atan(rho / (2 * r * k0))
    chi = math.asin(math.cos(far) * math.sin(chi0) + dy / rho * math.sin(far) * math.cos(chi0))
    lon = math.atan2(dx * math.sin(far), rho * math.cos(chi0) * math.cos(far) - dy * math.sin(chi0) * math.sin(far))
    return lon0 + math.degrees(lon / n), math.degrees(_from_isometric((math.asinh(math.tan(chi)) - math.log(c) / 2) / n, e))


def inverse_oblique_mercator(x: float, y: float, ell: tuple, lat0: float, lon0: float, k0: float, fe: float, fn: float) -> Point:
    """Oblique Mercator over a conformal sphere, its equator through the origin from west to east."""
    n, c, chi0, r, e = _sphere(ell, lat0)
    up, along = math.atan(math.sinh((y - fn) / (r * k0))), (x - fe) / (r * k0)
    chi = math.asin(math.cos(chi0) * math.sin(up) + math.sin(chi0) * math.cos(up) * math.cos(along))
    lon = math.atan2(math.sin(along), math.cos(chi0) * math.cos(along) - math.sin(chi0) * math.tan(up))
    return lon0 + math.degrees(lon / n), math.degrees(_from_isometric((math.asinh(math.tan(chi)) - c) / n, e))


def inverse_krovak(x: float, y: float, ell: tuple) -> Point:
    """Krovak's conic with an oblique axis; both coordinates are negative."""
    lat0, lon0, k0, azimuth, lat1 = math.radians(49.5), math.radians(24 + 50 / 60), 0.9999, math.radians(30 + 17 / 60 + 17.30311 / 3600), math.radians(78.5)
    a, f = ell
    n, c, _, r, e = _sphere(ell, 49.5)
    cone, r0 = math.sin(lat1), k0 * r / math.tan(lat1)
    theta, rho = math.atan2(-x, -y) / cone, math.hypot(x, y)
    s = 2 * (math.atan((r0 / rho) ** (1 / cone) * math.tan(lat1 / 2 + math.pi / 4)) - math.pi / 4)
    chi = math.asin(math.cos(azimuth) * math.sin(s) - math.sin(azimuth) * math.cos(s) * math.cos(theta))
    lon = math.asin(math.cos(s) * math.sin(theta) / math.cos(chi))
    return math.degrees(lon0 - lon / n), math.degrees(_from_isometric((math.asinh(math.tan(chi)) - c) / n, e))


METHODS = {
    "tm": lambda x, y, ell, lat0, lon0, k0, fe, fn: inverse_mercator(x, y, ell, lon0, k0, fe, lat0, fn),
    "lcc": inverse_lambert,
    "laea": inverse_equal_area,
    "sterea": inverse_stereographic,
    "somerc": inverse_oblique_mercator,
    "krovak": inverse_krovak,
}


def projected(method: str, ell: tuple, datum: tuple | None, parameters: dict, unit: float = 1.0) -> Transform:
    """A transform from the parameters of a system."""
    f = METHODS[method]
    plain = lambda x, y: f(x * unit, y * unit, ell, **parameters)
    return (lambda x, y: shift(*plain(x, y), ell, WGS84, datum)) if datum and any(datum) else plain


#: Names of methods and parameters in WKT.
WKT_METHODS = {"transverse_mercator": "tm", "gauss_kruger": "tm", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic": "lcc", "lambert_azimuthal_equal_area": "laea", "oblique_stereographic": "sterea", "double_stereographic": "sterea"}
WKT_PARAMETERS = {"latitude_of_origin": "lat0", "latitude_of_center": "lat0", "central_meridian": "lon0", "longitude_of_center": "lon0", "scale_factor": "k0", "false_easting": "fe", "false_northing": "fn", "standard_parallel_1": "lat1", "standard_parallel_2": "lat2"}


def from_wkt(text: str) -> Transform:
    """The transform of a projected or geographic system that WKT spells out."""
    number = r"\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s*"
    ball = re.search(rf'SPHEROID\s*\[\s*"[^"]*"\s*,{number},{number}', text, re.I)
    if not ball:
        raise UnknownCRS(text)
    ell = (float(ball[1]), 1 / float(ball[2]) if float(ball[2]) else 0.0)
    moved = re.search(r"TOWGS84\s*\[([^\]]*)\]", text, re.I)
    datum = tuple(float(v) for v in moved[1].split(",")) if moved else None
    datum = datum and (*datum, *(0.0,) * (7 - len(datum)))
    if not re.match(r"\s*PROJCS", text, re.I):
        return (lambda x, y: shift(x, y, ell, WGS84, datum)) if datum and any(datum) else lambda x, y: (x, y)
    name = re.search(r'PROJECTION\s*\[\s*"([^"]*)"', text, re.I)
    method = WKT_METHODS.get(re.sub(r"[\s-]+", "_", name[1]).lower()) if name else None
    if method is None:
        raise UnknownCRS(text)
    given = {WKT_PARAMETERS.get(k.lower(), k): float(v) for k, v in re.findall(rf'PARAMETER\s*\[\s*"([^"]*)"\s*,{number}', text, re.I)}
    units = re.findall(rf'UNIT\s*\[\s*"[^"]*"\s*,{number}', text, re.I)
    unit = float(units[-1]) if len(units) > 1 else 1.0
    own = {"lat0": 0.0, "lon0": 0.0, "fe": 0.0, "fn": 0.0} | ({"k0": 1.0} if method in ("tm", "sterea") else {}) | given
    if method == "lcc":
        own = {"lat1": own["lat0"]} | own
    own = {k: v * unit if k in ("fe", "fn") else v for k, v in own.items()}
    return projected(method, ell, datum, {k: v for k, v in own.items() if k in ("lat0", "lon0", "k0", "fe", "fn", "lat1", "lat2")}, unit)


def shift(lon: float, lat: float, source: tuple, target: tuple, p: tuple) -> Point:
    """A seven-parameter datum shift."""
    a, f = source
    e2, la, ph = f * (2 - f), math.radians(lon), math.radians(lat)
    nu = a / math.sqrt(1 - e2 * math.sin(ph) ** 2)
    x, y, z = nu * math.cos(ph) * math.cos(la), nu * math.cos(ph) * math.sin(la), nu * (1 - e2) * math.sin(ph)
    dx, dy, dz, rx, ry, rz, s = p
    rx, ry, rz, m = *(math.radians(r / 3600) for r in (rx, ry, rz)), 1 + s * 1e-6
    x, y, z = dx + m * (x - rz * y + ry * z), dy + m * (rz * x + y - rx * z), dz + m * (-ry * x + rx * y + z)
    a, f = target
    e2, r = f * (2 - f), math.hypot(x, y)
    ph = math.atan2(z, r * (1 - e2))
    for _ in range(8):
        ph = math.atan2(z + e2 * a / math.sqrt(1 - e2 * math.sin(ph) ** 2) * math.sin(ph), r)
    return math.degrees(math.atan2(y, x)), math.degrees(ph)


def _utm(zone: int, ell: tuple, south: bool = False) -> Transform:
    return lambda x, y: inverse_mercator(x, y - 1e7 * south, ell, zone * 6 - 183, 0.9996, 500_000)


def _gauss_krueger(zone: int) -> Transform:
    return lambda x, y: shift(*inverse_mercator(x, y, BESSEL, zone * 3, 1, zone * 1e6 + 500_000), BESSEL, WGS84, DHDN)


def _web(x: float, y: float) -> Point:
    return x / 6378137.0 * 180 / math.pi, (2 * math.atan(math.exp(y / 6378137.0)) - math.pi / 2) * 180 / math.pi


def register(code: str, transform: Transform) -> None:
    """Adds a system, as `EPSG:1234`; the transform gives (longitude, latitude)."""
    _REGISTRY[code.upper()] = transform


def decode(name: str) -> str:
    """`EPSG:n` or `CRS84` of a code, a URN (compound: its first part), an OGC URL or WKT with an authority."""
    text = name.strip()
    if "CRS84" in text.upper():
        return "CRS84"
    if m := re.search(r'AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]\s*\]\s*$', text, re.I):
        return f"EPSG:{m[1]}"
    if m := re.search(r"EPSG(?:::|:[\d.]*:|/[\d.]+/|:|\.xml#|#)(\d+)", text, re.I):
        return f"EPSG:{m[1]}"
    raise UnknownCRS(name)


def transform_for(name: str) -> Transform:
    try:
        return _by_code(decode(name), name)
    except UnknownCRS:
        if re.match(r"\s*(PROJCS|GEOGCS)\s*\[", name, re.I):
            return from_wkt(name)
        raise


def _by_code(code: str, name: str) -> Transform:
    if code in _REGISTRY:
        return _REGISTRY[code]
    if code == "CRS84":
        return lambda x, y: (x, y)
    n = int(code[5:])
    if n in (4326, 4258, 4979):  # latitude comes first
        return lambda x, y: (y, x)
    if n in (3857, 900913, 3785):
        return _web
    if 25828 <= n <= 25838:
        return _utm(n - 25800, GRS80)
    if 32601 <= n <= 32660 or 32701 <= n <= 32760:
        return _utm(n % 100, WGS84, n > 32700)
    if 31466 <= n <= 31469:
        return _gauss_krueger(n - 31464)
    if 23028 <= n <= 23038:
        return projected("tm", ELLIPSOIDS["Intl"], ED50, dict(lat0=0, lon0=(n - 23000) * 6 - 183, k0=0.9996, fe=500_000, fn=0))
    if 26901 <= n <= 26923:
        return _utm(n - 26900, GRS80)
    if 28348 <= n <= 28358 or 7846 <= n <= 7859:
        return _utm(n - (28300 if n > 9000 else 7800), GRS80, True)
    if n in SYSTEMS:
        method, ell, datum, parameters = SYSTEMS[n]
        return projected(method, ELLIPSOIDS[ell], datum, parameters)
    raise UnknownCRS(name)


def to_wgs84(name: str, points: list[Point]) -> list[Point]:
    f = transform_for(name)
    return [f(x, y) for x, y in points]
