"""Scalar column functions: keys, numbers, coordinate lists, references, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute names under which an object's id may stand, in order.
GML_ID_ATTRIBUTES = ["{http://www.opengis.net/gml}id", "{http://www.opengis.net/gml/3.2}id", "id"]

_INT = r"^[+-]?\d+(_\d+)*$"
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_NONFINITE = r"^(?i)[+-]?(nan|inf|infinity)$"
_SPACES = r"(?U)\s+"


def filled(c: Column) -> Column:
    """The string, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode white space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def local_name(tag: Column) -> Column:
    return F.substring_index(tag, "}", -1)


def gml_id(attrs: Column) -> Column:
    """The first non-empty id attribute of a map of attributes."""
    return F.coalesce(*[filled(attrs[name]) for name in GML_ID_ATTRIBUTES])


def resolve_xlink(href: Column) -> Column:
    return F.regexp_replace(href, "^#+", "")


def sanitize_key(name: Column) -> Column:
    """A lower-case key of letters, digits and single underscores; ``unnamed`` if nothing is left."""
    key = F.regexp_replace(strip(name), "[^0-9A-Za-z_]+", "_")
    key = F.regexp_replace(F.regexp_replace(key, "_+", "_"), "^_|_$", "")
    return F.coalesce(filled(F.lower(key)), F.lit("unnamed"))


def to_double(c: Column) -> Column:
    """The number that a token spells, NaN and infinities too; null for anything else."""
    plain = F.regexp_replace(c, "_", "").try_cast("double")
    return F.when(c.rlike(_FLOAT) | c.rlike(_NONFINITE), plain)


def parse_numeric(text: Column) -> Column:
    """struct(v_int, v_dbl, v_str): a whole number, else a number, else the stripped text."""
    t = strip(text)
    whole = F.when(t.rlike(_INT), F.regexp_replace(t, "_", "").try_cast("long"))
    real = F.when(whole.isNull(), to_double(t))
    return F.struct(whole.alias("v_int"), real.alias("v_dbl"), F.when(whole.isNull() & real.isNull(), t).alias("v_str"))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(text: Column) -> Column:
    """White-space separated numbers; null if any token is not one."""
    tokens = F.filter(F.split(text, _SPACES), lambda t: t != "")
    return _let(F.transform(tokens, to_double), lambda numbers: F.when(~F.exists(numbers, lambda x: x.isNull()), numbers))


def _three(a: Column) -> Column:
    return F.slice(F.concat(a, F.array(F.lit(0.0), F.lit(0.0))), 1, 3)


def parse_pos(text: Column) -> Column:
    """One position as three numbers: fewer are filled up with 0, more are cut; null if empty or bad."""
    return _let(doubles(text), lambda a: F.when(F.size(a) > 0, _three(a)))


def srs_dimension(raw: Column) -> Column:
    """The dimension of a position list: all digits, at least 2; 3 otherwise."""
    return F.greatest(F.coalesce(F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")), F.lit(3)), F.lit(2))


def parse_pos_list(text: Column, dimension: Column) -> Column:
    """Positions of a list; empty if any token is bad.

    A length that the dimension does not divide but 3 does is read by threes; a
    last chunk of one number is dropped.
    """
    none = F.array().cast("array<array<double>>")

    def cut(a: Column, n: Column, step: Column) -> Column:
        # the first numbers of all chunks of at least two
        count = ((n + step - 2) / step).cast("int")
        starts = F.transform(F.sequence(F.lit(1), count), lambda k: (k - 1) * step + 1)
        return F.when(count > 0, F.transform(starts, lambda i: _three(F.slice(a, i, step)))).otherwise(none)

    def read(a: Column) -> Column:
        n, d = F.size(a), srs_dimension(dimension)
        step = F.when((n % d != 0) & (n % 3 == 0), F.lit(3)).otherwise(d)
        return F.when(n > 1, _let(step, lambda w: cut(a, n, w))).otherwise(none)

    return F.coalesce(_let(doubles(text), lambda a: F.when(a.isNotNull(), read(a))), none)


def pos_list_size(text: Column, dimension: Column) -> Column:
    """How many positions parse_pos_list gives, without making them."""
    def count(n: Column) -> Column:
        d = srs_dimension(dimension)
        step = F.when((n % d != 0) & (n % 3 == 0), F.lit(3)).otherwise(d)
        return F.when(n > 1, ((n + step - 2) / step).cast("int")).otherwise(0)

    return F.coalesce(_let(F.size(doubles(text)), count), F.lit(0))


def target_refs(raw: Column) -> Column:
    """References of a target text: what follows the first #, empty ones dropped."""
    parts = F.transform(F.split(raw, _SPACES), lambda t: strip(F.regexp_replace(t, "^[^#]*#", "")))
    return F.filter(parts, lambda t: t != "")


def is_front(text: Column) -> Column:
    return F.lower(text) == "true"


def number_or_text(text: Column) -> Column:
    """struct(number, raw): one of the two is null."""
    x = to_double(strip(text))
    return F.struct(x.alias("number"), F.when(x.isNull(), text).alias("raw"))


def numbers_or_text(text: Column) -> Column:
    """struct(numbers, raw): a list of numbers such as a colour, or the text."""
    def read(x: Column) -> Column:
        good = x.isNotNull() & (F.size(x) > 0)
        return F.struct(F.when(good, x).alias("numbers"), F.when(~good, text).alias("raw"))

    return _let(doubles(text), read)


def surface_type(c: Column) -> Column:
    return F.coalesce(filled(strip(c)), F.lit("BoundarySurface"))


def type_node_id(surface: Column) -> Column:
    return F.concat(F.lit("boundary_surface_type::"), surface)


def safe_ratio(actual: Column, expected: Column) -> Column:
    """actual / expected, at most 1; 1 where nothing is expected."""
    return F.when(expected <= 0, F.lit(1.0)).otherwise(F.least(actual.cast("double") / expected, F.lit(1.0)))


def safe_label(label: Column) -> Column:
    """A label of letters, digits and underscores that starts with none of the digits."""
    x = F.regexp_replace(label, "[^0-9A-Za-z_]", "_")
    x = F.coalesce(filled(x), F.lit("UnknownType"))
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("N_"), x)).otherwise(x)


def bar(done: Column, total: Column, width: int = 26) -> Column:
    """A bar of # and -, of things done or of seconds against the most; empty where the total is not positive."""
    share = F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(done.cast("double") / total, F.lit(0.0)), F.lit(1.0)))
    k = F.bround(share * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), k), F.repeat(F.lit("-"), F.lit(width) - k))


def counter_text(key: str, n: str) -> Column:
    """Aggregate of (key, n) rows: key=n in the order of the keys."""
    pairs = F.transform(F.sort_array(F.collect_list(F.struct(key, n))), lambda p: F.concat(p[key], F.lit("="), p[n]))
    return F.array_join(pairs, ", ")


def within(value: Column, least: Column, most: Column) -> Column:
    """Whether a value lies between two bounds, either of which may be null."""
    return F.coalesce(value >= least, F.lit(True)) & F.coalesce(value <= most, F.lit(True))


def read_path(json: Column, path: str) -> Column:
    """The number at a dotted path of a JSON text, 0.0 for any failure."""
    return F.coalesce(F.get_json_object(json, f"$.{path}").try_cast("double"), F.lit(0.0))


def furniture_errors(has_geometry: Column, gml: Column, room: Column) -> Column:
    """What a piece of furniture lacks."""
    checks = F.array(
        F.when(~F.coalesce(has_geometry, F.lit(False)), F.lit("geometry")),
        F.when(filled(gml).isNull(), F.lit("gml_id")),
        F.when(filled(room).isNull(), F.lit("parent_room_id")),
    )
    return F.filter(checks, lambda e: e.isNotNull())


#: Fields of a piece of furniture, as columns of a table and keys of its properties.
FURNITURE_TEXTS, FURNITURE_LISTS = ["gml_id", "gml_name", "class", "parent_room_id"], ["function", "usage"]


def furniture_of(raw: Column) -> Column:
    """A piece of furniture from a map of texts: missing texts are null, lists are split at commas, geometry is there if named."""
    items = lambda k: F.filter(F.transform(F.split(F.coalesce(raw[k], F.lit("")), ","), strip), lambda t: t != "")
    return F.struct(*[filled(strip(raw[k])).alias(k) for k in FURNITURE_TEXTS], *[items(k).alias(k) for k in FURNITURE_LISTS], (filled(raw["geometry"]).isNotNull()).alias("has_geometry"))


def furniture_properties(piece: Column) -> Column:
    """The properties of a piece of furniture: what it has, lists as JSON."""
    entries = [F.struct(F.lit(k).alias("key"), piece[k].alias("value")) for k in FURNITURE_TEXTS]
    entries += [F.struct(F.lit(k).alias("key"), F.when(F.size(piece[k]) > 0, F.to_json(piece[k])).alias("value")) for k in FURNITURE_LISTS]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
