"""Sky and pixel geometry: vectors, the tangent-plane projection and pixel boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_ra(ra: Column) -> Column:
    r = ra % 360
    return F.when(r < 0, r + 360).otherwise(r)


def check_dec(dec: Column) -> Column:
    return dec.between(-90, 90)


def pixcen(x: Column) -> Column:
    """The pixel that has a place; pixel n spans n - 0.5 to n + 0.5."""
    return F.floor(x + 0.5)


def sky_to_vec(ra: Column, dec: Column) -> Column:
    a, d = F.radians(ra), F.radians(dec)
    return F.struct((F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z"))


def ang_sep(a: Column, b: Column) -> Column:
    """Angle in radians between two vectors; 0 where both products vanish."""
    cx, cy, cz = (a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])
    return F.atan2(F.sqrt(cx * cx + cy * cy + cz * cz), a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"])


def _wcs(w: Column | None, name: str) -> Column:
    return F.col(name) if w is None else w[name]


def plane(x: Column, y: Column, w: Column | None = None) -> tuple[Column, Column]:
    """Pixel to tangent plane, in radians."""
    dx, dy = x - _wcs(w, "crpix1"), y - _wcs(w, "crpix2")
    return F.radians(_wcs(w, "cd11") * dx + _wcs(w, "cd12") * dy), F.radians(_wcs(w, "cd21") * dx + _wcs(w, "cd22") * dy)


def pixel_to_sky(x: Column, y: Column, w: Column | None = None) -> Column:
    """struct<ra, dec> in degrees. `w` is a struct of the coordinate system; without it, columns of that name."""
    xi, eta = plane(x, y, w)
    a0, d0 = F.radians(_wcs(w, "crval1")), F.radians(_wcs(w, "crval2"))
    den = F.cos(d0) - eta * F.sin(d0)
    return F.struct(norm_ra(F.degrees(a0 + F.atan2(xi, den))).alias("ra"), F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + den * den))).alias("dec"))


def sky_to_pixel(ra: Column, dec: Column, w: Column | None = None) -> Column:
    """struct<x, y>, or null for a place on or behind the horizon of the plane."""
    a, d, d0 = F.radians(ra) - F.radians(_wcs(w, "crval1")), F.radians(dec), F.radians(_wcs(w, "crval2"))
    c = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    xi, eta = F.degrees(F.cos(d) * F.sin(a) / c), F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a)) / c)
    det = _wcs(w, "cd11") * _wcs(w, "cd22") - _wcs(w, "cd12") * _wcs(w, "cd21")
    x = _wcs(w, "crpix1") + (_wcs(w, "cd22") * xi - _wcs(w, "cd12") * eta) / det
    y = _wcs(w, "crpix2") + (_wcs(w, "cd11") * eta - _wcs(w, "cd21") * xi) / det
    return F.when(c > 0, F.struct(x.alias("x"), y.alias("y")))


def reach(x0: Column, y0: Column, dim: str, direction: int, size: Column, w: Column | None = None) -> Column:
    """Pixels from (x0, y0) along one axis to where the angle is `size` (radians); very far if it never is.

    On the plane the squared cosine of the angle is a ratio of quadratics in the step, so the
    place is a root and needs no search.
    """
    a, b = plane(x0, y0, w)
    names = ("cd11", "cd21") if dim == "x" else ("cd12", "cd22")
    u, t = (F.radians(_wcs(w, n)) for n in names)
    along, unit, norm = a * u + b * t, u * u + t * t, 1 + a * a + b * b
    c, s = F.cos(size), F.sin(size)
    q = c * c * norm * unit - along * along
    root = norm * s * (along * s + direction * c * F.sqrt(norm * unit - along * along)) / q
    return F.when((c > 0) & (q > 0), root).otherwise(direction * 1e9)


def pixel_search(x0: Column, y0: Column, dim: str, direction: int, size: Column, w: Column | None = None) -> Column:
    """The pixel along one axis whose inner edge is nearer than `size` and whose outer edge is not."""
    return pixcen((x0 if dim == "x" else y0) + reach(x0, y0, dim, direction, size, w))


def radius_bounds(x0: Column, y0: Column, dim: str, direction: int, size: Column, w: Column | None = None) -> Column:
    """The same in whole steps from the centre itself, half a step farther, rounded."""
    steps = F.floor(F.abs(reach(x0, y0, dim, direction, size, w)))
    return F.floor(F.abs((x0 if dim == "x" else y0) + direction * (steps + 0.5)) + 0.5)


def clamp_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, naxis1: Column, naxis2: Column) -> Column:
    """The box within the image, or null where they do not overlap."""
    overlap = (xmin <= naxis1) & (xmax >= 1) & (ymin <= naxis2) & (ymax >= 1)
    one = F.lit(1).cast("long")
    return F.when(overlap, F.struct(F.greatest(xmin, one).alias("xmin"), F.greatest(ymin, one).alias("ymin"), F.least(xmax, naxis1).alias("xmax"), F.least(ymax, naxis2).alias("ymax")))
