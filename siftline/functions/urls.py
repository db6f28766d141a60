"""URLs as the scanner reads them: a scheme, an authority, and escapes that hold throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import to_java
from .text import normalize, trim

SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*://"
USER = r"(?:[A-Za-z0-9._:~!$&'()*+,;=@-]|%[0-9A-Fa-f]{2})*"
NAME = r"""(?:[A-Za-z0-9._~!$&'()*+,;=\[\]<>"-]|[^\x00-\x7F]|%[89A-Fa-f][0-9A-Fa-f])"""
HOST = rf"(?:\[[^\]/?#]*\](?::[0-9]*)?|(?!\[){NAME}*(?::(?:{NAME}*:)*[0-9]*)?)"
TAIL = r"(?:/(?:[^?#%]|%[0-9A-Fa-f]{2})*)?(?:\?[^#]*)?(?:#(?:[^%]|%[0-9A-Fa-f]{2})*)?"
WHOLE = rf"(?s)^{SCHEME}(?:({USER})@)?({HOST}){TAIL}\z"
#: Fixed value: query parameters that carry secrets.
SECRET_PARAM = "(?i)(token|access[_-]?token|refresh[_-]?token|api[_-]?key|apikey|secret|sig|signature|credential|password|passwd|pwd)"


def is_url(value: Column) -> Column:
    """Whether a normalised value is a URL with a host, under a scheme that has one."""
    return value.rlike(WHOLE) & ~value.rlike(r"[\x00-\x1F\x7F]") & (F.regexp_extract(value, WHOLE, 2) != "")


def userinfo(value: Column) -> Column:
    """Whether a URL names a user, be it an empty one."""
    return value.rlike(rf"(?s)^{SCHEME}{USER}@{HOST}{TAIL}\z")


def unescaped(part: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(part, r"\+", "%2B"))


def username(value: Column) -> Column:
    return unescaped(F.substring_index(F.regexp_extract(value, WHOLE, 1), ":", 1))


def host(value: Column) -> Column:
    return unescaped(F.regexp_extract(value, WHOLE, 2))


def secret_param(value: Column) -> Column:
    """Whether a query parameter of a telling name has a value; pairs with a semicolon do not count."""
    query = F.regexp_extract(value, r"(?s)^[^#?]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: ~F.contains(p, F.lit(";")))

    def telling(pair: Column) -> Column:
        key = F.try_url_decode(F.substring_index(pair, "=", 1))
        given = F.try_url_decode(F.when(F.contains(pair, F.lit("=")), F.substring(pair, F.length(F.substring_index(pair, "=", 1)) + 2, F.length(pair))).otherwise(""))
        return F.coalesce(key.rlike(to_java(SECRET_PARAM)) & (trim(given) != ""), F.lit(False))

    return F.exists(pairs, telling)


def has_secret_param(value: Column) -> Column:
    v = normalize(value)
    return is_url(v) & secret_param(v)


def has_credentials(value: Column) -> Column:
    v = normalize(value)
    return is_url(v) & userinfo(v)


def plain_url(value: Column) -> Column:
    """A URL that gives nothing away."""
    v = normalize(value)
    return is_url(v) & ~userinfo(v) & ~secret_param(v)
