"""Stable keys: one spelling for identifiers and digests, and hashes that are equal on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Null for null or blank text."""
    c = _text(c)
    return F.when(F.trim(c) != "", c)


def item_text(c: Column | str) -> Column:
    """One spelling of a mother item, pair or stream id; empty for a blank one."""
    c = F.regexp_replace(F.lower(_text(c)), r"\s+", "")
    return F.regexp_replace(F.translate(c, "-", "_"), r"^(virl:|scene_v[0-9]+/)+", "")


def item_key(c: Column | str) -> Column:
    """One spelling of a mother item, pair or stream id: case, white space, dashes and name-space prefixes do not count.

    Null and blank ids stay null.
    """
    return F.nullif(item_text(c), F.lit(""))


def pair_mother_text(c: Column | str) -> Column:
    """The mother item named by a pair id, empty for a blank one."""
    return F.regexp_replace(item_text(c), r"__(l1|l2|l3|probe)(_r[0-9]+)?$", "")


def pair_mother_key(c: Column | str) -> Column:
    """The mother item named by a pair id: what precedes the layer and the revision."""
    return F.nullif(pair_mother_text(c), F.lit(""))


def digest_text(c: Column | str) -> Column:
    """One spelling of a digest; empty for a blank one."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), r"\s+", ""), r"^sha256:", "")


def digest_key(c: Column | str) -> Column:
    """One spelling of a digest: case, white space and an algorithm prefix do not count."""
    return F.nullif(digest_text(c), F.lit(""))


def unit_hash(key: Column | str, salt: str) -> Column:
    """Uniform value in [0, 1) of a text key and a fixed salt: the first 52 bits of an MD5 digest. Null for a null key."""
    digest = F.md5(F.concat(F.lit(salt + "|"), _text(key)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


#: The same functions as DuckDB expressions; ``{}`` stands for the column.
SQL_ITEM_KEY = r"nullif(regexp_replace(replace(regexp_replace(lower({}), '\s+', '', 'g'), '-', '_'), '^(virl:|scene_v[0-9]+/)+', ''), '')"
SQL_PAIR_MOTHER_KEY = r"nullif(regexp_replace(" + SQL_ITEM_KEY + r", '__(l1|l2|l3|probe)(_r[0-9]+)?$', ''), '')"
SQL_DIGEST_KEY = r"nullif(regexp_replace(regexp_replace(lower({}), '\s+', '', 'g'), '^sha256:', ''), '')"
SQL_UNIT_HASH = "(('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
