"""Column functions over boxes, points and text; all of them stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

L, T, R, B = "left", "top", "right", "bottom"


def width() -> Column:
    return F.col(R) - F.col(L)


def height() -> Column:
    return F.col(B) - F.col(T)


def center_x() -> Column:
    return (F.col(L) + F.col(R)) / 2


def center_y() -> Column:
    return (F.col(T) + F.col(B)) / 2


def is_empty() -> Column:
    return (width() <= 0) | (height() <= 0)


def area() -> Column:
    return width() * height()


def contains(x, y) -> Column:
    return (F.col(L) <= x) & (F.col(R) >= x) & (F.col(T) <= y) & (F.col(B) >= y)


def intersects(left, top, right, bottom) -> Column:
    return (F.col(L) <= right) & (F.col(R) >= left) & (F.col(T) <= bottom) & (F.col(B) >= top)


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def distance_to_box(x, y) -> Column:
    dx = F.greatest(F.col(L) - x, F.lit(0.0), x - F.col(R))
    dy = F.greatest(F.col(T) - y, F.lit(0.0), y - F.col(B))
    return F.sqrt(dx * dx + dy * dy)


def aspect(w, h) -> Column:
    return F.greatest(w, h) / F.greatest(F.lit(0.000001), F.least(w, h))


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def affine(m: tuple[float, ...], x, y) -> tuple[Column, Column]:
    """(m11, m12, m21, m22, ox, oy) applied to a point."""
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def append(m: tuple[float, ...], n: tuple[float, ...]) -> tuple[float, ...]:
    """First m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


#: Millimetres in a unit.
UNITS = {"Millimeter": 1.0, "Inch": 25.4, "PdfPoint": 25.4 / 72.0}


def converted(value: Column, unit: Column, target: str) -> Column:
    """value from unit to target; a unit without a size, as Pixel, is an error."""
    factor = F.raise_error(F.concat(F.lit("no conversion from "), unit)).cast("double")
    for name, mm in UNITS.items():
        factor = F.when(unit == name, F.lit(mm)).otherwise(factor)
    return value * factor / UNITS[target]


def rotation(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


#: Letters that have no single capital, which stay as they are; and what stands for them meanwhile.
NO_CAPITAL = "ßŉǰΐΰևẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"
_MEANWHILE = "".join(chr(0xE000 + k) for k in range(len(NO_CAPITAL)))


def reference(text: Column) -> Column:
    """A designator with letters, digits and underscores only, in upper case, letter by letter."""
    kept = F.regexp_replace(F.trim(text), r"[^\p{L}\p{Nd}_]", "")
    any_ = F.translate(F.upper(F.translate(kept, NO_CAPITAL, _MEANWHILE)), _MEANWHILE, NO_CAPITAL)
    return F.when(text.rlike(r"^[A-Za-z0-9_]*\z"), F.upper(text)).otherwise(any_)


def without_side(text: Column) -> Column:
    return F.regexp_replace(text, "_E$", "")


def slug(name: Column) -> Column:
    return F.concat(F.lit("net-"), F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]", "-"), F.lit("-")))


def color(component: Column) -> Column:
    """Two hex digits of a colour component that is a share of one, or already up to 255."""
    scaled = F.when(component <= 1, component * 255).otherwise(component)
    return F.lpad(F.hex(F.rint(clamp(scaled, 0.0, 255.0)).cast("int")), 2, "0")


def rgb(red: Column, green: Column, blue: Column) -> Column:
    return F.concat(F.lit("#"), color(red), color(green), color(blue))


def inflate(amount: float) -> list[Column]:
    """left, top, right and bottom of the boxes, larger by `amount` on every side."""
    if amount < 0:
        raise ValueError("a box is inflated by 0 or more")
    return [(F.col(L) - amount).alias(L), (F.col(T) - amount).alias(T), (F.col(R) + amount).alias(R), (F.col(B) + amount).alias(B)]


def unit_vector(x: Column, y: Column) -> tuple[Column, Column]:
    """The vector of length one with the same direction; zero for a vector without length."""
    length = F.sqrt(x * x + y * y)
    return tuple(F.when(length <= 5e-324, F.lit(0.0)).otherwise(v / length) for v in (x, y))


def translate(x: float, y: float) -> tuple[float, ...]:
    return (1.0, 0.0, 0.0, 1.0, x, y)


def scale(x: float, y: float) -> tuple[float, ...]:
    return (x, 0.0, 0.0, y, 0.0, 0.0)


def rotate(degrees: float) -> tuple[float, ...]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (c, s, -s, c, 0.0, 0.0)


def to_world(x: Column, y: Column, origin: tuple[float, float], matrix: tuple[float, ...], unit: str) -> tuple[Column, Column]:
    """A point of a coordinate space in millimetres: the origin is added, then the matrix applied, then the unit."""
    a, b = affine(matrix, x + origin[0], y + origin[1])
    return a * UNITS[unit], b * UNITS[unit]


#: Bounds of a camera's zoom.
LEAST_ZOOM, MOST_ZOOM = 0.02, 500.0


def fitted(width: float, height: float, padding: float, zoom: Column | float = 1.0, pan_x: Column | float = 0.0, pan_y: Column | float = 0.0) -> dict[str, Column]:
    """scale, offset_x and offset_y that fit each box into a view of this size; an empty box has scale 1 and no offset."""
    free = lambda size: max(1.0, size - 2 * padding)
    fit = F.least(F.lit(free(width)) / F.greatest(R_L(), F.lit(0.000001)), F.lit(free(height)) / F.greatest(B_T(), F.lit(0.000001)))
    size = F.greatest(F.lit(0.000001), fit * zoom)
    given = lambda value, otherwise: F.when(is_empty(), F.lit(otherwise)).otherwise(value)
    return {"scale": given(size, 1.0), "offset_x": given((width - R_L() * size) / 2 + pan_x, 0.0), "offset_y": given((height - B_T() * size) / 2 + pan_y, 0.0)}


R_L, B_T = width, height


def to_screen(x: Column, y: Column, view: dict[str, Column]) -> tuple[Column, Column]:
    return view["offset_x"] + (x - F.col(L)) * view["scale"], view["offset_y"] + (y - F.col(T)) * view["scale"]


def from_screen(x: Column, y: Column, view: dict[str, Column]) -> tuple[Column, Column]:
    return F.col(L) + (x - view["offset_x"]) / view["scale"], F.col(T) + (y - view["offset_y"]) / view["scale"]


def zoomed_at(x: Column, y: Column, factor: Column, width: float, height: float, padding: float, zoom: Column, pan_x: Column, pan_y: Column) -> dict[str, Column]:
    """zoom, pan_x and pan_y after zooming by `factor` around a point of the screen, under which the same point stays."""
    near = from_screen(x, y, fitted(width, height, padding, zoom, pan_x, pan_y))
    after = clamp(zoom * factor, LEAST_ZOOM, MOST_ZOOM)
    moved = to_screen(*near, fitted(width, height, padding, after, pan_x, pan_y))
    return {"zoom": after, "pan_x": F.when(after == zoom, pan_x).otherwise(pan_x + x - moved[0]), "pan_y": F.when(after == zoom, pan_y).otherwise(pan_y + y - moved[1])}


def rendered(points: Column, zoom: Column | float = 1.0) -> Column:
    """Pixels of a length in points: 96 of them to an inch of 72 points, times the zoom, rounded up."""
    return F.ceil(points * (F.lit(96.0 / 72.0) * zoom)).cast("int")


def whole_pixels(value: Column) -> Column:
    """Halves away from zero."""
    return F.round(value).cast("int")


def looked_up(properties: Column, key: str) -> Column:
    """The value of a key of a map, without regard to case and the space around it."""
    return F.element_at(F.transform_keys(properties, lambda k, _: F.lower(F.trim(k))), key.strip().lower())


def with_property(properties: Column, key: str, value: Column) -> Column:
    """The map with a key set; a key that differs in case only goes."""
    rest = F.map_filter(properties, lambda k, _: F.lower(F.trim(k)) != key.strip().lower())
    return F.map_concat(rest, F.create_map(F.lit(key.strip()), value))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\\\]*?)(?:\.[^./\\\\]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
