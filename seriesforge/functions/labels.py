"""Label sets as columns: sorted identity, display text, 64-bit fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label that holds a metric's name.
NAME_LABEL = "__name__"


def label_map(**labels) -> Column:
    """A label map of columns or literals; a null value leaves its label out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), (v if isinstance(v, Column) else F.lit(v)).alias("value")) for k, v in labels.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def label_key(labels: Column) -> Column:
    """The identity of a label set: its entries sorted by key.  Arrays compare, group and join; maps do not."""
    return F.array_sort(F.map_entries(labels))


def valid_labels(labels: Column) -> Column:
    """Whether a label set has a label, no empty key and no null value."""
    return labels.isNotNull() & (F.size(labels) > 0) & ~F.exists(F.map_entries(labels), lambda e: (e["key"] == "") | e["value"].isNull())


def canonical(key: Column) -> Column:
    """Display text ``{k="v",...}`` of an identity; quotes and backslashes in values are escaped."""
    quoted = F.transform(key, lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def fingerprint(key: Column) -> Column:
    """FNV-1a, 64 bits, signed, over ``key=value;`` of each entry in order, as UTF-8.

    The product by the FNV prime 0x100000001b3 is (h << 40) + 435 h; 32-bit halves
    keep it from overflowing.  Different label sets can share a fingerprint
    (a value may hold ``;`` and ``=``), so it is no identity.
    """
    data = F.encode(F.array_join(F.transform(key, lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), ""), "UTF-8")
    # in Latin-1 each byte is a character
    each = F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit("(?s)(.)"), F.lit(1))
    low = F.lit(0xFFFFFFFF)

    def step(acc: Column, c: Column) -> Column:
        x = acc["lo"].bitwiseXOR(F.ascii(c).cast("long"))
        hi = (acc["hi"] * 435 + F.shiftrightunsigned(x * 435, 32) + F.shiftleft(x, 8)).bitwiseAND(low)
        return F.struct(hi.alias("hi"), (x * 435).bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(each, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


def label_or_blank(labels: Column, name: str) -> Column:
    """A label's value; blank where it is missing."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def block_id(min_ts: Column, max_ts: Column) -> Column:
    return F.format_string("block-%013d-%013d", min_ts, max_ts)


def intervals_overlap(min_ts: Column, max_ts: Column, start: int, end: int) -> Column:
    """Whether closed intervals meet; touching ends count."""
    return (min_ts <= end) & (max_ts >= start)
