"""UTM zone 43N and WGS84 as SQL expressions: the Krüger series to the third order of n, below a millimetre in a zone."""

from __future__ import annotations

import math

AXIS, FLATTENING, SCALE, FALSE_EAST, MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 75.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = SCALE * AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def _d(x: float) -> str:
    return f"({x:.17e})"


def _series(weights, first: str, a: str, second: str | None = None, b: str = "") -> str:
    return " + ".join(f"{_d(w)} * {first}({2 * j} * {a})" + (f" * {second}({2 * j} * {b})" if second else "") for j, w in enumerate(weights, 1))


def to_wgs84(x: str, y: str) -> tuple[str, str]:
    """Longitude and latitude in degrees of metres east and north."""
    xi, eta = f"(({y}) / {_d(RADIUS)})", f"((({x}) - {_d(FALSE_EAST)}) / {_d(RADIUS)})"
    u = f"({xi} - ({_series(BETA, 'sin', xi, 'cosh', eta)}))"
    v = f"({eta} - ({_series(BETA, 'cos', xi, 'sinh', eta)}))"
    chi = f"asin(sin({u}) / cosh({v}))"
    return f"{_d(MERIDIAN)} + degrees(atan2(sinh({v}), cos({u})))", f"degrees({chi} + {_series(DELTA, 'sin', chi)})"


def to_utm(lon: str, lat: str) -> tuple[str, str]:
    """Metres east and north of degrees."""
    e = _d(2 * math.sqrt(N) / (1 + N))
    s, turn = f"sin(radians({lat}))", f"radians(({lon}) - {_d(MERIDIAN)})"
    t = f"sinh(atanh({s}) - {e} * atanh({e} * {s}))"
    u, v = f"atan2({t}, cos({turn}))", f"atanh(sin({turn}) / sqrt(1 + {t} * {t}))"
    return (
        f"{_d(FALSE_EAST)} + {_d(RADIUS)} * ({v} + {_series(ALPHA, 'cos', u, 'sinh', v)})",
        f"{_d(RADIUS)} * ({u} + {_series(ALPHA, 'sin', u, 'cosh', v)})",
    )
