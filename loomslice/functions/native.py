"""Scrubbing as Spark expressions: deterministic for a key, within whole-stage code where Spark has it.

Every transform is a function of a string column and a key. The key holds the pepper and the transform's
name; what a value becomes depends on the value and the key alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import LISTS

#: General categories by the kind of character they are written as.
UPPER, LOWER, DIGIT = r"\p{Lu}\p{Lt}\p{Co}\p{So}", r"\p{Ll}\p{Lm}\p{Lo}", r"\p{Nd}\p{Nl}\p{No}"


def hash60(text: Column, key: str, salt: str = "") -> Column:
    """60 bits of md5, as a number."""
    return F.conv(F.substr(F.md5(F.concat(text, F.lit(key + salt))), F.lit(1), F.lit(15)), 16, 10).cast("long")


def choose(values: tuple, h: Column) -> Column:
    return F.when(h.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), (h % len(values) + 1).cast("int")))


def like_case(value: Column, model: Column, *, title: bool = True) -> Column:
    """value in upper or lower case, or with a capital, as model is written; else as it is."""
    out = F.when(model.rlike(f"^[{UPPER}]+$"), F.upper(value)).when(model.rlike(f"^[{LOWER}]+$"), F.lower(value))
    if title:
        out = out.when(model.rlike(f"^[{UPPER}][{LOWER}]+$"), F.concat(F.upper(F.substr(value, F.lit(1), F.lit(1))), F.lower(F.substr(value, F.lit(2)))))
    return out.otherwise(value)


def _unless_empty(c: Column, out: Column) -> Column:
    return F.when(c.isNull() | (c == ""), c).otherwise(out)


def address_line1(c: Column, key: str, streets: tuple = LISTS["street"]) -> Column:
    street = like_case(choose(streets, hash60(c, key)), F.regexp_replace(c, "[^a-zA-Z]", ""), title=False)
    return _unless_empty(c, F.concat((hash60(c, key, "number") % 9999 + 1).cast("string"), F.lit(" "), street))


def address_line2(c: Column, key: str) -> Column:
    return _unless_empty(c, F.concat(F.lit("#"), (hash60(c, key) % 999 + 1).cast("string")))


def city(c: Column, key: str, cities: tuple = LISTS["city"]) -> Column:
    return _unless_empty(c, like_case(choose(cities, hash60(c, key)), c, title=False))


def us_state(c: Column, key: str, *, abbr: bool = False, values: tuple = ()) -> Column:
    return _unless_empty(c, choose(values or LISTS["state_abbr" if abbr else "state"], hash60(F.upper(c), key)))


def given_name(c: Column, key: str, names: tuple = LISTS["given_name"]) -> Column:
    return like_case(choose(names, hash60(F.upper(c), key)), c, title=False)


def surname(c: Column, key: str, names: tuple = LISTS["surname"]) -> Column:
    return like_case(choose(names, hash60(F.upper(c), key)), c, title=False)


def geozip(c: Column, key: str, zips: tuple = LISTS["zip"]) -> Column:
    """A code with the same first three characters, or any if there is none."""
    groups: dict[str, list[str]] = {}
    for z in zips:
        groups.setdefault(z[:3], []).append(z)
    table = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(F.try_element_at(table, F.substr(c, F.lit(1), F.lit(3))), F.array(*map(F.lit, zips)))
    out = F.element_at(own, (hash60(c, key) % F.size(own) + 1).cast("int"))
    return F.when(c.isNotNull(), F.when(F.length(out) < 5, F.lpad(out, 5, "0")).otherwise(out))


def alphanumeric(c: Column, key: str) -> Column:
    """Letters to letters of the same case and digits to digits, by their position; all else stays."""
    seed = F.md5(F.concat(F.upper(c), F.lit(key)))

    def one(x: Column, i: Column) -> Column:
        h = F.conv(F.substr(F.md5(F.concat(seed, i.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long")
        letter = lambda base, n: F.chr(F.lit(base) + h % n)
        return F.when(x.rlike(f"[{UPPER}]"), letter(65, 26)).when(x.rlike(f"[{LOWER}]"), letter(97, 26)).when(x.rlike(f"[{DIGIT}]"), letter(48, 10)).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def words(c: Column, key: str, values: tuple = LISTS["word"]) -> Column:
    """Runs of letters to words of their length (or of the greatest there is) in their case; digits to digits."""
    by_length: dict[int, list[str]] = {}
    for v in values:
        by_length.setdefault(len(v), []).append(v)
    table = F.create_map(*[x for k, v in by_length.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    seed = F.md5(F.concat(F.upper(c), F.lit(key)))

    def one(x: Column, i: Column) -> Column:
        h = F.conv(F.substr(F.md5(F.concat(seed, i.cast("string"))), F.lit(1), F.lit(15)), 16, 10).cast("long")
        own = F.coalesce(F.try_element_at(table, F.length(x)), F.element_at(table, F.lit(max(by_length))))
        word = like_case(F.element_at(own, (h % F.size(own) + 1).cast("int")), x)
        return F.when(x.rlike(f"^[{UPPER}{LOWER}]"), word).when(x.rlike(f"^[{DIGIT}]"), (h % 10).cast("string")).otherwise(x)

    tokens = F.regexp_extract_all(c, F.lit(f"([{UPPER}{LOWER}]+|(?s:.))"), 1)
    return _unless_empty(c, F.array_join(F.transform(tokens, one), ""))


def const(c: Column, value) -> Column:
    return F.when(c.isNotNull(), F.lit(str(value)))


def null(c: Column) -> Column:
    return F.lit(None).cast("string")


def replace(c: Column, old: str, new: str) -> Column:
    """All occurrences of a literal, in any case. new is literal too."""
    quoted = re.sub(r"([\\$])", r"\\\1", new)
    return F.regexp_replace(c, "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", old), quoted)


def date_year(c: Column, key: str) -> Column:
    """A day of the same year; text in ISO form."""
    day = F.to_date(c, "yyyy-MM-dd")
    first = F.make_date(F.year(day), F.lit(1), F.lit(1))
    days = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    return F.date_format(F.date_add(first, (hash60(c, key) % days).cast("int")), "yyyy-MM-dd")


def compose(c: Column, steps) -> Column:
    return reduce(lambda x, f: f(x), steps, c)
