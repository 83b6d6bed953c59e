"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def xyz(prefix: str = "") -> Vector:
    return tuple(F.col(f"{prefix}{a}") for a in "xyz")


def add(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vector, k) -> Vector:
    return tuple(p * k for p in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(sub(a, b))


def project(p: Vector, origin: Vector, direction: Vector) -> Column:
    """Position of a point along an axis."""
    return dot(sub(p, origin), direction)


def segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    """Distance from a point to a closed segment."""
    ab = sub(b, a)
    length = dot(ab, ab)
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(p, a), ab) / length))).otherwise(F.lit(0.0))
    return distance(p, add(a, scale(ab, t)))


def minimum_image(d: Column, box: Column | float) -> Column:
    """A difference in a periodic box, halves to even."""
    return d - box * F.rint(d / box)


def transform(p: Vector, rotation: list[list], shift: list) -> Vector:
    """Row vector times a matrix, plus a shift."""
    return tuple(p[0] * rotation[0][j] + p[1] * rotation[1][j] + p[2] * rotation[2][j] + shift[j] for j in range(3))


def torsion(a: Vector, b: Vector, c: Vector, d: Vector, least: float = 0.4, most: float = 2.2) -> Column:
    """Dihedral angle in degrees; null if a bond is shorter than ``least`` or longer than ``most``."""
    u, v, w = sub(b, a), sub(c, b), sub(d, c)
    n, m = cross(u, v), cross(v, w)
    fine = F.lit(True)
    for bond in (u, v, w):
        fine = fine & norm(bond).between(least, most)
    return F.when(fine, F.degrees(F.atan2(dot(cross(n, m), v) / norm(v), dot(n, m))))


def nearest_even_index(x: Column) -> Column:
    """Lattice index, halves to even."""
    return F.rint(x).cast("long")


def half_up_index(x: Column) -> Column:
    """Lattice index, halves up."""
    return F.floor(x + 0.5).cast("long")


def packed_key(i: Column, j: Column, k: Column) -> Column:
    """Three indices of 21 bits, offset to be positive, in one number."""
    bias = 1 << 20
    return F.shiftleft(i + bias, 42).bitwiseOR(F.shiftleft(j + bias, 21)).bitwiseOR(k + bias)


def slab_state(s: Column, low: float, high: float, lateral: Column) -> Column:
    """below, above, inside, or out (in the slab, beside the lumen); bounds belong to the slab."""
    return F.when(s < low, "below").when(s > high, "above").when(lateral, "inside").otherwise("out")


def void_class(to_edge: Column, radius: Column) -> Column:
    return F.when(to_edge <= 6, "surface_proximal").when(radius >= 6, "large_connected_candidate").otherwise("buried_cavity")


def resolution_check(narrowest: Column, spacing: Column | float) -> Column:
    return F.when(narrowest.isNull(), "not_assessed").when(narrowest < spacing * F.lit(2.0), "warning").otherwise("ok")


def influence(gap: Column, samples: Column, role: Column) -> Column:
    bonus = F.when(role == "bottleneck", 1.0).when(role == "lining", 0.25).otherwise(0.0)
    return 1 / (F.lit(0.25) + gap) + F.lit(0.15) * F.log1p(samples.cast("double")) + bonus


def contact_role(gap: Column, near_bottleneck: Column) -> Column:
    return F.when((gap <= 1.0) & near_bottleneck, "bottleneck").when(gap <= 1.0, "lining").when(near_bottleneck, "bottleneck-nearby").otherwise("nearby")


def accession(text: Column) -> Column:
    """A normalised four-character entry code, or null."""
    code = F.upper(F.trim(text))
    return F.when(code.rlike("^[0-9][A-Z0-9]{3}$"), code)


#: Residue names by property; a residue may have several.
PROPERTIES = {
    "hydrophobic": ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO", "TYR"),
    "polar": ("SER", "THR", "ASN", "GLN", "CYS", "TYR", "HIS", "TRP"),
    "positive": ("ARG", "LYS", "HIS"),
    "negative": ("ASP", "GLU"),
    "aromatic": ("PHE", "TYR", "TRP", "HIS"),
    "small": ("GLY", "ALA", "SER", "CYS"),
}


def residue_properties(resname: Column) -> Column:
    """All properties of a residue name, in the order of the table; ``other`` for a name without any."""
    name = F.upper(F.trim(resname))
    found = F.array_compact(F.array(*[F.when(name.isin(*names), kind) for kind, names in PROPERTIES.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def formal_charge(resname: Column) -> Column:
    name = F.upper(F.trim(resname))
    return F.when(name.isin("ARG", "LYS"), 1).when(name.isin("ASP", "GLU"), -1).otherwise(0)


def half_of(frame: Column, frames: Column | int) -> Column:
    return F.when(frame < F.floor(F.lit(frames) / 2 if isinstance(frames, int) else frames / 2), 0).otherwise(1)


def block_of(frame: Column, frames: Column, blocks: int) -> Column:
    """Contiguous block of a frame: min(frame * blocks // frames, blocks - 1)."""
    return F.least(F.floor(frame * blocks / frames), F.lit(blocks - 1)).cast("long")


def basis_of(direction: Vector) -> tuple[Vector, Vector]:
    """Two unit vectors at right angles to a direction and to each other."""
    unit = lambda v: tuple(c / norm(v) for c in v)
    axis = unit(direction)
    steep = F.abs(axis[2]) > 0.9
    reference = (F.lit(0.0), F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0))
    u = unit(cross(axis, reference))
    return u, unit(cross(axis, u))


def named_axis(name: str) -> tuple[float, float, float]:
    """A unit vector from an axis' name, or from three numbers with commas between them."""
    axes = {"x": (1.0, 0.0, 0.0), "y": (0.0, 1.0, 0.0), "z": (0.0, 0.0, 1.0)}
    if name.strip().lower() in axes:
        return axes[name.strip().lower()]
    parts = [p.strip() for p in name.split(",")]
    if len(parts) != 3:
        raise ValueError("an axis is x, y, z or three numbers with commas between them")
    v = tuple(map(float, parts))
    size = sum(c * c for c in v) ** 0.5
    if not size:
        raise ValueError("an axis has a length")
    return tuple(c / size for c in v)


def parsed_coord(text: Column) -> Column:
    """x, y and z as a struct from a text of three numbers with commas between them; null for any other."""
    parts = F.split(text, ",")
    at = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    fine = (F.size(parts) == 3) & at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull()
    return F.when(fine, F.struct(at(0).alias("x"), at(1).alias("y"), at(2).alias("z")))


def cell_vectors(lengths: tuple[float, float, float], angles: tuple[float, float, float]) -> list[tuple[float, float, float]]:
    """The three vectors of a periodic cell from its lengths and its angles in degrees; no cell for impossible ones."""
    import math

    a, b, c = lengths
    if min(lengths) <= 0 or not all(0 < x < 180 for x in angles):
        raise ValueError("a cell has positive lengths and angles between 0 and 180 degrees")
    ca, cb, cg = (0.0 if x == 90 else math.cos(math.radians(x)) for x in angles)
    sg = 1.0 if angles[2] == 90 else math.sin(math.radians(angles[2]))
    y = c * (ca - cb * cg) / sg
    z2 = c * c - (c * cb) ** 2 - y * y
    if z2 <= 0:
        raise ValueError("no cell has these angles")
    return [(a, 0.0, 0.0), (b * cg, b * sg, 0.0), (c * cb, y, math.sqrt(z2))]


def minimum_image_in(v: Vector, cell: list[tuple[float, float, float]]) -> Column:
    """The shortest image (x, y, z) of a vector in a periodic cell of any shape, among the 27 around its own cell."""
    from itertools import product

    (ax, _, _), (bx, by, _), (cx, cy, cz) = cell
    k = F.rint(v[2] / cz)
    y = v[1] - k * cy
    j = F.rint(y / by)
    x = v[0] - k * cx - j * bx
    i = F.rint(x / ax)
    near = (x - i * ax, y - j * by, v[2] - k * cz)
    images = []
    for n in product((0, -1, 1), repeat=3):
        moved = tuple(near[d] + F.lit(sum(m * cell[e][d] for e, m in enumerate(n))) for d in range(3))
        images.append(F.struct(dot(moved, moved).alias("_q"), F.lit(len(images)).alias("_n"), *[c.alias(p) for c, p in zip(moved, "xyz", strict=True)]))
    best = F.array_min(F.array(*images))
    return F.struct(*[best[p].alias(p) for p in "xyz"])


#: Identifiers of entries, extended ones, and of predicted models with their protein's accession.
ENTRY, EXTENDED = "^[0-9][A-Za-z0-9]{3}$", "^pdb_[0-9a-z]{8}$"
MODEL_ID = r"^AF-([0-9A-Z]{6,10})-F([1-9][0-9]*)(?:-MODEL_V([1-9][0-9]*))?(?:\.(PDB|CIF))?$"
PROTEIN = "^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$"


def entry_code(text: Column) -> Column:
    """A normalised entry code: an extended one in lower case, one of four characters in upper case, or null."""
    bare = F.trim(text)
    return F.when(F.lower(bare).rlike(EXTENDED), F.lower(bare)).when(bare.rlike(ENTRY), F.upper(bare))


def model_id(text: Column) -> Column:
    """protein, fragment, version and suffix of a predicted model's name (a path's last part), or null."""
    bare = F.upper(F.element_at(F.split(F.trim(text), "/"), -1))
    part = lambda i: F.nullif(F.regexp_extract(bare, MODEL_ID, i), F.lit(""))
    fine = bare.rlike(MODEL_ID) & F.regexp_extract(bare, MODEL_ID, 1).rlike(PROTEIN)
    return F.when(fine, F.struct(part(1).alias("protein"), part(2).cast("int").alias("fragment"), part(3).cast("int").alias("version"), F.lower(part(4)).alias("suffix")))


def ladder_neighbours(value: Column, ladder: list[float]) -> Column:
    """The ladder's values next below and next above (1e-9 apart at least), as an array of two, one or none."""
    below = [F.when(F.lit(float(v)) < value - 1e-9, F.lit(float(v))) for v in sorted(ladder)]
    above = [F.when(F.lit(float(v)) > value + 1e-9, F.lit(float(v))) for v in sorted(ladder)]
    pick = lambda best, all_: best(*all_) if len(all_) > 1 else all_[0]
    return F.array_compact(F.array(pick(F.greatest, below), pick(F.least, above)))


def standard_variants(margin: float | None = None, probe: float | None = None, grid: float | None = None, ladder: tuple = (), delta: float = 1.0, grids: tuple = ()) -> list[tuple[str, float]]:
    """Settings to try beside the chosen ones: margins ``delta`` off (not below 0), the ladder's neighbours of the probe, other grids."""
    out = [] if margin is None else [("margin", m) for m in (margin - delta, margin + delta) if m >= 0]
    if probe is not None:
        values = sorted(map(float, ladder))
        below, above = [v for v in values if v < probe - 1e-9], [v for v in values if v > probe + 1e-9]
        out += [("probe", v) for v in below[-1:] + above[:1]]
    return out + ([] if grid is None else [("grid", g) for g in grids if abs(g - grid) > 1e-9 * max(abs(g), abs(grid))])


def tokens(text: Column) -> Column:
    """Different tokens in order: a text with white space within is one, any other is split at commas."""
    bare = F.trim(text)
    parts = F.when(bare.rlike(r"\s"), F.array(bare)).otherwise(F.transform(F.split(bare, ","), lambda t: F.trim(t)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def charge_overrides(text: Column) -> Column:
    """A map of upper-case names to charges from ``NAME=q`` items with commas between them; a wrong item is an error."""
    items = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    pair = r"^(.*\S)\s*=\s*([^=]+)$"
    number = lambda t: F.trim(F.regexp_extract(t, pair, 2)).try_cast("double")
    entry = lambda t: F.struct(F.upper(F.trim(F.regexp_extract(t, pair, 1))), F.coalesce(number(t), F.raise_error(F.concat(F.lit("a charge is NAME=q, not "), t)).cast("double")))
    return F.map_from_entries(F.transform(items, entry))


def field_voltage(field: Vector, box: Vector, axis: Vector) -> Column:
    """Millivolts over a box (in tenths of the field's length unit) of a field along one box axis; null for none or a skew one.

    The sign is that of the channel axis along the field's box axis, which must lie within 45 degrees of it.
    """
    some = [F.coalesce(e != 0, F.lit(False)) for e in field]
    one = sum((c.cast("int") for c in some), F.lit(0)) == 1
    size = norm(axis)
    parts = [F.when(c & (F.abs(a / size) >= F.lit(0.5**0.5)), 1000 * e * b / 10 * F.signum(a)) for c, e, b, a in zip(some, field, box, axis, strict=True)]
    return F.when(one, F.coalesce(*parts))
