"""String functions with the exact semantics that ingestion needs."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Text without white space (tabs and line breaks too) at both ends; null stays null."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_empty(c: Column) -> Column:
    """Null, blank and any case of "nan" as the empty text."""
    own = F.coalesce(stripped(c), F.lit(""))
    return F.when(F.lower(own) == "nan", "").otherwise(own)


def header_key(c: Column) -> Column:
    """A header's canonical form: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(stripped(c)), "[^a-z0-9]", "")


def header_key_of(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.strip().lower())


def first_token(c: Column) -> Column:
    """What stands before the first semicolon."""
    return stripped(F.split_part(c, F.lit(";"), F.lit(1)))


def synonyms(c: Column) -> Column:
    """A pipe list's entries without blanks and the mark for none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), stripped), lambda x: (x != "") & (x != "-"))


def union_of_tags(*columns: Column) -> Column:
    """Semicolon lists as one, in order, each entry once."""
    parts = F.split(F.concat_ws(";", *columns), ";")
    return F.array_join(F.array_distinct(F.filter(F.transform(parts, stripped), lambda x: x != "")), ";")


def tagged(c: Column, tag: str) -> Column:
    """The distinct values that follow ``tag:`` in a semicolon list, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"{tag}:([^;]+)"), F.lit(1)))


def significant(c: Column) -> Column:
    """A number with nine significant digits, as the printf form %.9g of C has it: no zeros at the end, an exponent below -4 and from 9 on."""
    raw = F.format_string("%.8e", F.abs(c.cast("double")))
    e = F.regexp_extract(raw, r"e([+-]\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_extract(raw, r"^([0-9.]+)e", 1), r"\.", "")
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(9)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    far = F.concat(trim(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 9))), F.regexp_extract(raw, r"(e[+-]\d+)$", 1))
    plain = F.when((e < -4) | (e >= 9), far).when(e >= 0, trim(whole)).otherwise(trim(small))
    shown = F.when(c.cast("double") == 0, F.lit("0")).otherwise(F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), plain))
    return F.when(c.isNotNull(), shown)


def protein_key(entrez: Column) -> Column:
    return F.when(entrez.rlike("^[0-9]+$"), F.concat(F.lit("protein:ncbi:"), entrez))


def slug(text: str, most: int = 64) -> str:
    """A portable name: ASCII, lower case, runs of other characters as one underscore. Parts of paths, and texts that leave nothing, are errors."""
    if "/" in text or "\\" in text or ".." in text:
        raise ValueError("a name is no path")
    out = _slugged(text, most)
    if not out:
        raise ValueError("nothing of the name is left")
    return out


def _slugged(text: str, most: int) -> str:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")[:most].rstrip("_")


def stable_json(value: object) -> str:
    """JSON with sorted keys; non-finite numbers are errors."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))


def digest(value: object) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


def artifact_id(payload: object) -> str:
    """The name of a result: a- and the first half of the digest of what describes it."""
    return f"a-{digest(payload)[:32]}"


def iso_time(c: Column) -> Column:
    """A timestamp in UTC as ISO text with microseconds and Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_iso(c: Column) -> Column:
    """ISO text with an offset or Z as a timestamp; null where it is none."""
    return F.try_to_timestamp(c)


def seconds_between(start: Column, finish: Column) -> Column:
    """The seconds from start to finish, not below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(finish.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6)


def json_list(c: Column) -> Column:
    """A cell's JSON list of texts; null where the cell is empty or no list."""
    return F.from_json(F.nullif(stripped(F.coalesce(c, F.lit(""))), F.lit("")), "array<string>")


def without_keys(value: object, word: str) -> object:
    """A document without the keys, at any depth, whose name has a word in it."""
    if isinstance(value, dict):
        return {k: without_keys(v, word) for k, v in value.items() if word not in str(k).casefold()}
    return [without_keys(v, word) for v in value] if isinstance(value, (list, tuple)) else value


def without_fields(df, word: str):
    """A table without the columns, and fields of structs at any depth, whose name has a word in it."""
    from pyspark.sql.types import ArrayType, StructType

    def kept(kind, c: Column) -> Column:
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[kept(f.dataType, c[f.name]).alias(f.name) for f in kind.fields if word not in f.name.casefold()]))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: kept(kind.elementType, x))
        return c

    return df.select(*[kept(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields if word not in f.name.casefold()])


def portable_segment(name: str) -> bool:
    """Whether a path segment is portable: no separators, no leading dot, no device names."""
    return bool(re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9._-]{0,127}", name)) and not name.endswith(".") and not re.fullmatch(r"(?i)(con|prn|aux|nul|com\d|lpt\d)(\..*)?", name)
